"""Session construction and shared-folder helpers."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on: UTC session zone (telemetry timestamps are
# TIMESTAMP_NTZ and streaming casts them to TIMESTAMP), AQE for runtime
# re-planning (partition coalescing, skew-join splitting, broadcast by
# measured size).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Reliable checkpoints of intermediates are deleted once unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "tankwise", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster the launcher supplies master and sizing."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting wins; only when it is unset in a local session (tests) a
    fresh folder under /tmp is chosen and registered; elsewhere that raises.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = os.path.join("/tmp", f"tankwise-ckpt-{uuid.uuid4().hex[:12]}")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder (never machine-local
    on a cluster); used for staged files, models and stream outputs."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tankwise/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """SQL settings for the jobs run inside; the caller's come back afterwards."""
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever the job was
    started from: a zip in the shared folder, added to the context once."""
    sc = spark.sparkContext
    if getattr(sc, "_tankwise_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(here):          # already imported from a shipped zip
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(here)):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("tankwise", os.path.relpath(full, here)))
    path = sc._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "package") + "/tankwise_package.zip")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(fs.makeQualified(path).toString())
    sc._tankwise_shipped = True
