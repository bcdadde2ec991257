"""Structured Streaming forms of the batch jobs (ST1-ST6).

Event time: ``withWatermark`` needs TIMESTAMP, so the stream edge casts the
NTZ ``ts`` to TIMESTAMP (session zone UTC) and outputs cast back.

``run_*`` functions take a streaming telemetry DataFrame and a sink folder,
run with ``availableNow`` (replays what has arrived, then stops) and return
the batch-readable result, so each stream can be checked against the batch
SQL of the same job.  Checkpoints live under the shared checkpoint folder.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankwise.session import scratch_path, settings, ship_package
from tankwise.sources.tables import table, telemetry_from_events
from tankwise.sources.upserts import Published, UpsertTable
from tankwise.streaming.fuel_drop import OUT_SCHEMA, FuelDrop

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


# ------------------------------------------------------------------ staging
def stage_events(spark: SparkSession, events: DataFrame, path: str, chunks: int = 6,
                 files_per_chunk: int = 4, resend: DataFrame | None = None) -> int:
    """Write ``events`` as time-ordered chunks, one chunk after another, each
    exactly ``files_per_chunk`` files, so file modification order follows
    event time and ``maxFilesPerTrigger=files_per_chunk`` replays one chunk
    per micro-batch.  ``resend`` (optional) is appended last as a replay.
    Returns the number of micro-batches staged."""
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    if lo is None:
        return 0
    span = (hi - lo) / chunks
    n = 0
    for i in range(chunks):
        a = lo + span * i
        b = lo + span * (i + 1)
        cond = (F.col("ts") >= F.lit(a)) & ((F.col("ts") < F.lit(b)) if i < chunks - 1 else F.lit(True))
        events.filter(cond).repartition(files_per_chunk).write.mode("append").parquet(path)
        n += 1
    if resend is not None:
        resend.repartition(files_per_chunk).write.mode("append").parquet(path)
        n += 1
    return n


def stage_heartbeat(spark: SparkSession, path: str, after: dt.timedelta) -> None:
    """One row without a unit, ``after`` the newest staged time."""
    newest = spark.read.schema(EVENTS_SCHEMA).parquet(path).agg(F.max("ts")).first()[0]
    if newest is not None:
        spark.createDataFrame([(None, newest + after, None, None, None, None)], EVENTS_SCHEMA).coalesce(1) \
            .write.mode("append").parquet(path)


def read_stream(spark: SparkSession, path: str, files_per_chunk: int = 4) -> DataFrame:
    return (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", files_per_chunk)
            .parquet(path))


def stream_telemetry(spark: SparkSession, events_stream: DataFrame) -> DataFrame:
    t = telemetry_from_events(spark, events_stream)
    return t.withColumn("ets", F.col("ts").cast("timestamp"))


def _run(writer, name: str):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


# ------------------------------------------------------------------ ST1
def state_table(spark: SparkSession, out: str) -> UpsertTable:
    return UpsertTable(spark, out, "equipment_id")


def run_equipment_state(stream: DataFrame, out: str, ckpt: str) -> None:
    """ST1: live latest row + idle/active counters per unit.  Update mode: an epoch
    carries the units that changed and becomes one change set of a versioned table,
    which is read through ``state_table``."""
    running = F.col("operational_status") == "Running"
    agg = stream.where("equipment_id is not null").groupBy("equipment_id").agg(
        F.max_by(F.struct("ts", "event_id", "equipment_type", "fuel_level", "operational_status",
                          "maintenance_status"), F.struct("ts", "event_id")).alias("latest"),
        F.count_if(running & (F.col("idle_time") > 0)).cast("long").alias("total_idle_time"),
        F.count_if(running & ~F.coalesce(F.col("idle_time") > 0, F.lit(False))).cast("long").alias("total_active_time"),
        F.count(F.lit(1)).cast("long").alias("n_readings"))
    table_ = state_table(stream.sparkSession, out)

    def write(batch: DataFrame, epoch: int):
        table_.apply(batch.select("equipment_id", "latest.*", "total_idle_time", "total_active_time", "n_readings"), epoch)

    _run(agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", ckpt), "st1")


# ------------------------------------------------------------------ ST2 / ST3
def run_consumption_daily(stream: DataFrame, out: str, ckpt: str, delay: str = "1 hour") -> None:
    """ST2: tumbling daily mean consumption by type; append after the watermark.

    The mean accumulates in DECIMAL(18,6): state merged across micro-batches
    and partitions in any order gives the same result (exact sum)."""
    exact = F.col("fuel_consumed").cast("decimal(18,6)")
    agg = (stream.withWatermark("ets", delay)
                 .groupBy(F.window("ets", "1 day"), "equipment_type")
                 .agg(F.avg(exact).cast("double").alias("avg_consumption"),
                      F.count(F.lit(1)).cast("long").alias("n")))
    res = agg.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                     F.col("window.end").cast("timestamp_ntz").alias("window_end"),
                     "equipment_type", "avg_consumption", "n")
    _run(res.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", ckpt), "st2")


def run_consumption_sliding(stream: DataFrame, out: str, ckpt: str, delay: str = "1 hour") -> None:
    """ST3: trailing-24h consumption per type, sliding hourly."""
    agg = (stream.withWatermark("ets", delay)
                 .groupBy(F.window("ets", "24 hours", "1 hour"), "equipment_type")
                 .agg(F.sum("fuel_consumed").alias("total_consumed"), F.count(F.lit(1)).cast("long").alias("n")))
    res = agg.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                     F.col("window.end").cast("timestamp_ntz").alias("window_end"),
                     "equipment_type", "total_consumed", "n")
    _run(res.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", ckpt), "st3")


# ------------------------------------------------------------------ ST4
LAGLESS_RULES = ["Idle", "Sensor", "Engine Overheating", "Excessive Load", "Oil Pressure"]


def run_alerts(stream: DataFrame, bounds: Published, out: str, ckpt: str) -> None:
    """ST4: stateless alerts -- the per-type 3-sigma bounds plus the rules that need no
    lag.  Every micro-batch takes the bounds' newest version, broadcast if their count
    allows and shuffled otherwise; an epoch's alerts replace what an earlier try of the
    same epoch wrote."""
    from tankwise.operators.anomaly import SIGMA_METRICS, rule_flags
    from tankwise.operators.joins import join_checked
    flags = rule_flags()

    def write(batch: DataFrame, epoch: int):
        j = join_checked(batch, bounds.read(), "equipment_type", "inner", materialize=False)
        stat = F.concat_ws(",", *[F.when((F.col(m) < F.col(f"_{m}_lo")) | (F.col(m) > F.col(f"_{m}_hi")), F.lit(m))
                                  for m in SIGMA_METRICS])
        j = j.withColumn("_stat", stat)
        kinds = [F.when(flags[k], F.lit(k)) for k in LAGLESS_RULES]
        kinds.append(F.when(F.length("_stat") > 0, F.concat(F.lit("Statistical:"), F.col("_stat"))))
        res = j.select("event_id", "equipment_id", "ts", F.explode(F.array_compact(F.array(*kinds))).alias("alert"))
        res.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    _run(stream.writeStream.foreachBatch(write).option("checkpointLocation", ckpt), "st4")


def alerts_table(spark: SparkSession, out: str) -> DataFrame:
    return (spark.read.schema("event_id long, equipment_id string, ts timestamp_ntz, alert string, epoch long")
            .option("basePath", out).parquet(out).drop("epoch"))


# ------------------------------------------------------------------ ST5
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_fuel_drop(stream: DataFrame, out: str, ckpt: str, delay: str = "2 hours", silence_days: int = 60) -> None:
    """ST5: fuel-drop alerts in event-time order (``fuel_drop.FuelDrop``).  Readings up to
    ``delay`` late are put in order, later ones are dropped; rows without a unit only
    move the clock; a unit that is silent for ``silence_days`` is forgotten."""
    # no filter on the unit here: it would be pushed below the watermark and the clock rows with it
    src = (stream.withWatermark("ets", delay)
           .select("event_id", "equipment_id", "ts", "ets", "fuel_level", "fuel_consumed", "refuel_event"))
    spark = stream.sparkSession
    ship_package(spark)
    with settings(spark, {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}):
        res = src.groupBy("equipment_id").transformWithStateInPandas(
            FuelDrop(silence_days * 86_400_000), OUT_SCHEMA, "Append", "EventTime")
        _run(res.writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", ckpt), "st5")


# ------------------------------------------------------------------ ST6
def run_dedup(stream: DataFrame, out: str, ckpt: str, delay: str = "7 days") -> None:
    """ST6: replay-safe ingest -- a reading resent within the watermark delay
    is dropped (key: unit and timestamp)."""
    res = (stream.withWatermark("ets", delay)
                 .dropDuplicatesWithinWatermark(["equipment_id", "ts"])
                 .select("event_id", "equipment_id", "ts"))
    _run(res.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", ckpt), "st6")


# ------------------------------------------------------------------ harness
def replay(spark: SparkSession, sf_dir: str, runner, name: str, chunks: int = 6, files_per_chunk: int = 4,
           resend_filter=None, heartbeat: dt.timedelta | None = None, reader=None, **kw) -> DataFrame:
    """Stage ``events`` under the shared folder, run ``runner`` over the
    stream and return the sink as a batch DataFrame (through ``reader`` if given).
    ``heartbeat`` adds, last, one row without a unit that much after the newest one:
    it moves the watermark past all readings."""
    base = scratch_path(spark, f"stream-{name}")
    ev = table(spark, sf_dir, "events")
    resend = None
    if resend_filter is not None:
        lo = ev.agg(F.max("ts")).first()[0]
        resend = ev.filter(resend_filter(lo))
    stage_events(spark, ev, f"{base}/input", chunks, files_per_chunk, resend)
    if heartbeat is not None:
        stage_heartbeat(spark, f"{base}/input", heartbeat)
    stream = stream_telemetry(spark, read_stream(spark, f"{base}/input", files_per_chunk))
    runner(stream, f"{base}/output", f"{base}/checkpoint", **kw)
    return reader(spark, f"{base}/output") if reader else spark.read.parquet(f"{base}/output")
