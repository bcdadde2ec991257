"""Streaming: state across micro-batches, late data, replays."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from support import SF_SMALL
from tankwise.operators import anomaly as A
from tankwise.operators import joins
from tankwise.operators.sequence import latest_by
from tankwise.session import scratch_path
from tankwise.sources.tables import table, telemetry
from tankwise.sources.upserts import Published, UpsertTable
from tankwise.streaming import fuel_drop as FD
from tankwise.streaming import jobs as J


def _batch_theft(spark):
    t = telemetry(spark, SF_SMALL)
    r = A.anomaly_rules(t, spark.createDataFrame([], "equipment_type string, metric string, mean double"))
    return {x["event_id"] for x in r.filter(F.col("anomaly_type") == "Fuel Theft").collect()}


def test_fuel_drop_state_across_batches_and_late_file(spark):
    base = scratch_path(spark, "t-stream")
    ev = table(spark, SF_SMALL, "events")
    n = J.stage_events(spark, ev, f"{base}/in", chunks=5, files_per_chunk=1)
    # a late, already-seen-older reading for an existing unit arrives last
    late = ev.orderBy("ts").limit(3).withColumn("event_id", F.col("event_id") + 10_000_000)
    late.repartition(1).write.mode("append").parquet(f"{base}/in")
    J.stage_heartbeat(spark, f"{base}/in", dt.timedelta(hours=3))
    assert n == 5
    stream = J.stream_telemetry(spark, J.read_stream(spark, f"{base}/in", 1))
    J.run_fuel_drop(stream, f"{base}/out", f"{base}/ck")
    got = {r["event_id"] for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == _batch_theft(spark)


def test_daily_window_drops_rows_behind_watermark(spark):
    base = scratch_path(spark, "t-daily")
    ev = table(spark, SF_SMALL, "events")
    J.stage_events(spark, ev, f"{base}/in", chunks=4, files_per_chunk=1)
    lo = ev.agg(F.min("ts")).first()[0]
    late = ev.filter(F.col("ts") < F.lit(lo + dt.timedelta(days=1))).withColumn(
        "event_id", F.col("event_id") + 10_000_000)
    late.repartition(1).write.mode("append").parquet(f"{base}/in")
    stream = J.stream_telemetry(spark, J.read_stream(spark, f"{base}/in", 1))
    J.run_consumption_daily(stream, f"{base}/out", f"{base}/ck")
    out = spark.read.parquet(f"{base}/out")
    first_day = out.filter(F.col("window_start") == F.lit(dt.datetime(lo.year, lo.month, lo.day)))
    exp_n = ev.filter(F.col("ts") < F.lit(dt.datetime(lo.year, lo.month, lo.day) + dt.timedelta(days=1))).count()
    assert first_day.agg(F.sum("n")).first()[0] == exp_n        # the late copies were not counted


# ------------------------------------------------------------ ST5: order, lateness, expiry
def _shuffled(spark, base, seed):
    """Events within half an hour of one another swap places: files hold them out of order."""
    ev = table(spark, SF_SMALL, "events")
    moved = ev.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")) + F.rand(seed) * 1.8e9)
    cuts = moved.approxQuantile("_at", [0.25, 0.5, 0.75], 0)
    edges = [float("-inf"), *cuts, float("inf")]
    for lo, hi in zip(edges, edges[1:]):
        moved.where((F.col("_at") >= lo) & (F.col("_at") < hi)).drop("_at").repartition(1).write.mode("append").parquet(f"{base}/in")


def _drops(spark, base):
    J.stage_heartbeat(spark, f"{base}/in", dt.timedelta(hours=3))
    J.run_fuel_drop(J.stream_telemetry(spark, J.read_stream(spark, f"{base}/in", 1)), f"{base}/out", f"{base}/ck")
    return [r["event_id"] for r in spark.read.parquet(f"{base}/out").collect()]


def test_fuel_drop_puts_out_of_order_files_in_order(spark):
    base = scratch_path(spark, "t-shuffled")
    _shuffled(spark, base, 5)
    got = _drops(spark, base)
    assert len(got) == len(set(got)) and set(got) == _batch_theft(spark)


def test_fuel_drop_ignores_resent_and_late_files(spark):
    base = scratch_path(spark, "t-late")
    _shuffled(spark, base, 6)
    ev = table(spark, SF_SMALL, "events")
    ev.where("event_id % 5 = 0").repartition(1).write.mode("append").parquet(f"{base}/in")
    ev.orderBy("ts").limit(5).withColumn("event_id", F.col("event_id") + 10_000_000).repartition(1) \
        .write.mode("append").parquet(f"{base}/in")
    got = _drops(spark, base)
    assert len(got) == len(set(got)) and set(got) == _batch_theft(spark)


def _reading(i, unit, ts, k, kind="click"):
    return (i, ts, unit, kind, 1.0, f'{{"k": {k}}}')


def test_a_silent_unit_is_forgotten(spark):
    base, t0 = scratch_path(spark, "t-silent"), dt.datetime(2024, 1, 1)
    day = dt.timedelta(days=1)
    first = [_reading(1, 1, t0, 90), _reading(2, 2, t0, 90), _reading(3, 2, t0 + 20 * day, 90)]
    # unit 1 comes back 40 days later with an emptier tank: its last level is gone; unit 2 was not silent so long
    second = [_reading(4, 1, t0 + 40 * day, 10), _reading(5, 2, t0 + 41 * day, 10), _reading(6, 1, t0 + 41 * day, 1)]
    for part in (first, [_reading(7, 3, t0 + 35 * day, 50)], second):
        spark.createDataFrame(part, J.EVENTS_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    J.stage_heartbeat(spark, f"{base}/in", dt.timedelta(hours=3))
    J.run_fuel_drop(J.stream_telemetry(spark, J.read_stream(spark, f"{base}/in", 1)), f"{base}/out", f"{base}/ck", silence_days=30)
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{base}/out").collect()) == [5, 6]


def test_pieces_are_swept_in_order_and_few_are_held():
    rng = np.random.default_rng(1)
    rows = np.zeros(20_000, FD.ROW)
    rows["ts"], rows["id"] = rng.integers(0, 100 * FD.MINUTE, 20_000), rng.permutation(20_000)
    kept = {}
    for chunk in np.split(rows, 10):
        for p in FD.pieces(chunk[np.lexsort((chunk["id"], chunk["ts"]))]):
            kept[int(p["ts"][0]), int(p["ts"][-1]), len(kept)] = p
    held, most = set(), 0

    def load(k):
        nonlocal most
        held.add(k)
        most = max(most, sum(len(kept[x]) for x in held))
        return kept[k]
    out = []
    for run in FD.in_order(list(kept), load):
        out.append(run)
        held = {k for k in held if k[1] > run["ts"][-1]}
    out = np.concatenate(out)
    assert most < 1_000
    np.testing.assert_array_equal(out, rows[np.lexsort((rows["id"], rows["ts"]))])


# ------------------------------------------------------------ ST1: upserts
def test_a_repeated_epoch_changes_nothing_and_readers_keep_their_version(spark):
    folder = scratch_path(spark, "t-upsert")
    t = UpsertTable(spark, folder, "k")
    batch = lambda rows: spark.createDataFrame(rows, "k string, v int")     # noqa: E731
    assert t.apply(batch([("a", 1), ("b", 1)]), 0)
    before = t.read()
    assert t.apply(batch([("b", 2), ("c", 2)]), 1)
    assert not t.apply(batch([("b", 9), ("c", 9)]), 1) and not t.apply(batch([("a", 9)]), 0)
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 2), ("c", 2)]
    assert sorted(map(tuple, before.collect())) == [("a", 1), ("b", 1)]
    for e in range(2, 40):
        t.apply(batch([(f"k{e % 7}", e)]), e)
    want = {"a": 1, "b": 2, "c": 2, **{f"k{e % 7}": e for e in range(2, 40)}}
    assert dict(map(tuple, t.read().collect())) == want
    assert len(t.log.latest()[1]["changes"]) < 16
    t.compact()
    assert t.vacuum(keep=1) > 0 and t.log.latest()[1]["changes"] == []
    assert dict(map(tuple, t.read().collect())) == want


def test_state_table_is_whole_while_a_stream_writes(spark):
    """A second run over more files adds to the table; its first version stays readable."""
    base = scratch_path(spark, "t-state")
    ev = table(spark, SF_SMALL, "events")
    half = ev.where("event_id % 2 = 0")
    J.stage_events(spark, half, f"{base}/in", chunks=3, files_per_chunk=1)

    def run():
        J.run_equipment_state(J.stream_telemetry(spark, J.read_stream(spark, f"{base}/in", 1)), f"{base}/out", f"{base}/ck")
    run()
    t = J.state_table(spark, f"{base}/out")
    early, version = t.read(), t.log.latest()[0]
    assert early.agg(F.sum("n_readings")).first()[0] == half.count()
    ev.where("event_id % 2 = 1").repartition(2).write.mode("append").parquet(f"{base}/in")
    run()
    assert t.read().agg(F.sum("n_readings")).first()[0] == ev.count()
    assert early.agg(F.sum("n_readings")).first()[0] == half.count() == t.read(version).agg(F.sum("n_readings")).first()[0]
    latest = {r["equipment_id"]: r["event_id"] for r in t.read().collect()}
    want = {r["equipment_id"]: r["event_id"] for r in latest_by(telemetry(spark, SF_SMALL)).collect()}
    assert latest == want


# ------------------------------------------------------------ ST4: bounds that change
def test_alerts_take_new_bounds_between_batches(spark, monkeypatch):
    base = scratch_path(spark, "t-bounds")
    t = telemetry(spark, SF_SMALL)
    wide = A._wide_bounds(A.sigma_thresholds(A.unannotated(t)), "equipment_type", A.SIGMA_METRICS)
    bounds = Published(spark, f"{base}/bounds")
    bounds.publish(wide)
    ev = table(spark, SF_SMALL, "events")

    def run():
        J.run_alerts(J.stream_telemetry(spark, J.read_stream(spark, f"{base}/in", 1)), bounds, f"{base}/out", f"{base}/ck")

    def statistical():
        return {r["event_id"] for r in J.alerts_table(spark, f"{base}/out").where("alert like 'Statistical:%fuel_consumed%'").collect()}
    ev.where("event_id < 500").repartition(1).write.mode("append").parquet(f"{base}/in")
    run()
    assert not any(e >= 500 for e in statistical())
    bounds.publish(wide.withColumn("_fuel_consumed_hi", F.lit(-1.0)))          # from now on every reading is above
    monkeypatch.setattr(joins, "BROADCAST_MAX_ROWS", 0)
    monkeypatch.setattr(joins.join_checked, "__defaults__", ("inner", 0, True))          # and no bound may be broadcast
    old = statistical()
    ev.where("event_id >= 500").repartition(1).write.mode("append").parquet(f"{base}/in")
    run()
    assert statistical() - old == {r["event_id"] for r in ev.where("event_id >= 500").collect()}
