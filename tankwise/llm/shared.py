"""Tables in the shared folder, and connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tankwise.session import scratch_path, ship_package


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back:
    cuts the lineage with files that outlive any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing will read again."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with this package importable in the workers, which give
    freed memory back when a task ends (idle workers stay for the next stage)."""
    ship_package(df.sparkSession)

    def run(batches):
        yield from fn(batches)
        give_back()
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return this process's freed memory to the machine."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc only
    if trim is not None:
        trim(0)


BROADCAST_IDS = 4_000_000   # ids sent to all tasks instead of shuffling texts, at most (about 100 MB)


def of_ids(rows: DataFrame, ids: DataFrame, how: str, key: str) -> DataFrame:
    """``rows`` whose ``key`` is (left_semi) or is not (left_anti) in ``ids``, a
    stored table of that one column; the rows are shuffled only if the ids are too
    many to send round."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def let(value, fn):
    """``fn(value)`` with ``value`` computed once per row however often ``fn`` uses
    it (bound as the variable of a one-element array)."""
    return F.get(F.transform(F.array(value), fn), 0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every id in ``edges(a, b)``; component is the
    smallest id reachable.

    Large-star / small-star rounds: each is two grouped minima and two joins on
    a vertex, stored in the shared folder; stops when the edge set is a forest
    of stars.  Ids without an edge are not listed."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
               .distinct(), "cc")
    seen = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        nxt = stored(small, "cc")
        dropped(e)
        e = nxt
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if now[0] == 0 or now == seen:
            break
        seen = now
    return (e.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
