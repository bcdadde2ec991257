"""Skew-safe ordered operators equal their naive single-window forms."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tankwise.operators import features as FE
from tankwise.operators import sequence as SQ
from tankwise.operators.sequence import (halo_chunks, chunk_window, latest_by, ordered_split,
                                         trailing)


def _skewed(spark, seed=7):
    """One hot unit with most rows over many days (incl. near-empty days),
    a few small units, irregular gaps."""
    rnd = random.Random(seed)
    rows, eid = [], 0
    base = dt.datetime(2024, 3, 1)
    for unit, n, spread_days in (("HOT", 900, 20), ("A", 30, 20), ("B", 5, 3), ("C", 1, 1)):
        for _ in range(n):
            ts = base + dt.timedelta(seconds=rnd.randint(0, spread_days * 86400))
            rows.append((eid, ts, unit, float(rnd.randint(0, 100)), float(rnd.randint(0, 50)),
                         float(rnd.randint(0, 60)), float(rnd.randint(500, 3000))))
            eid += 1
    # a day with a single reading for HOT far away (halo must reach back across it)
    rows.append((eid, base + dt.timedelta(days=40), "HOT", 1.0, 2.0, 3.0, 700.0))
    return spark.createDataFrame(
        rows, "event_id long, ts timestamp_ntz, equipment_id string, fuel_level double, "
              "fuel_consumed double, speed double, rpm double").withColumn("load_pct", F.col("speed") * 2)


def test_halo_rolling_equals_naive(spark):
    df = _skewed(spark)
    names = [f"avg_{s}_{k}h" for k in FE.ROLL_FRAMES for s in FE.ROLL_MEASURES]
    got = FE.with_rolling(df).select("event_id", *names)
    w = Window.partitionBy("equipment_id").orderBy("ts", "event_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("equipment_id"))
    exp = df
    for k in FE.ROLL_FRAMES:
        for short, src in FE.ROLL_MEASURES.items():
            exp = exp.withColumn(f"avg_{short}_{k}h", F.coalesce(
                F.when(n >= k, F.avg(src).over(w.rowsBetween(-(k - 1), 0))), F.col(src)))
    exp = exp.select("event_id", *[f"avg_{s}_{k}h" for k in FE.ROLL_FRAMES for s in FE.ROLL_MEASURES])
    a = {r[0]: [round(x, 9) for x in r[1:]] for r in got.collect()}
    b = {r[0]: [round(x, 9) for x in r[1:]] for r in exp.collect()}
    assert a == b


def test_halo_lag_equals_naive(spark):
    df = _skewed(spark)
    got = {r["event_id"]: (r["prev_fuel_level"], r["fuel_level_change"])
           for r in FE.with_lags(df).collect()}
    w = Window.partitionBy("equipment_id").orderBy("ts", "event_id")
    exp = df.select("event_id", F.coalesce(F.lag("fuel_level").over(w), F.col("fuel_level")).alias("p"),
                    F.coalesce(F.col("fuel_level") - F.lag("fuel_level").over(w), F.lit(0.0)).alias("c"))
    assert got == {r[0]: (r[1], r[2]) for r in exp.collect()}


def test_halo_rows_only_the_needed_ones(spark):
    df = _skewed(spark)
    c = halo_chunks(df, halo_rows=3)
    # every non-halo row appears exactly once
    assert c.filter(~F.col("_halo")).count() == df.count()
    # each chunk receives at most 3 halo rows
    mx = c.filter("_halo").groupBy("equipment_id", "_chunk").count().agg(F.max("count")).first()[0]
    assert mx <= 3


def test_avg_load_3h_equals_naive(spark):
    df = _skewed(spark)
    got = {r["event_id"]: round(r["avg_load_3h"], 9) for r in FE.with_avg_load_3h(df).collect()}
    w = (Window.partitionBy("equipment_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp")))
         .rangeBetween(-3 * 3600 * 1_000_000, 0))
    exp = {r[0]: round(r[1], 9) for r in df.select("event_id", F.avg("load_pct").over(w)).collect()}
    assert got == exp


def test_ordered_split_equals_global_order(spark):
    df = _skewed(spark)
    got = {r["event_id"]: r["is_train"] for r in ordered_split(df, 0.8).collect()}
    rows = sorted(df.select("equipment_id", "ts", "event_id").collect())
    cut = int(len(rows) * 0.8)
    exp = {r["event_id"]: i < cut for i, r in enumerate(rows)}
    assert got == exp


def test_latest_by_breaks_ties_on_id(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, "X", 1.0), (2, t, "X", 2.0), (3, t - dt.timedelta(hours=1), "X", 3.0)],
                               "event_id long, ts timestamp_ntz, equipment_id string, v double")
    r = latest_by(df).collect()
    assert len(r) == 1 and r[0]["event_id"] == 2 and r[0]["v"] == 2.0


def test_trailing_is_inclusive(spark):
    t = dt.datetime(2024, 1, 2)
    df = spark.createDataFrame([(1, t), (2, t - dt.timedelta(hours=24)), (3, t - dt.timedelta(hours=24, seconds=1))],
                               "event_id long, ts timestamp_ntz")
    assert sorted(r[0] for r in trailing(df, hours=24).collect()) == [1, 2]


def test_chunk_window_partitioning_is_by_key_and_chunk(spark):
    df = _skewed(spark)
    c = halo_chunks(df, halo_rows=1)
    plan = c.withColumn("x", F.lag("fuel_level").over(chunk_window()))._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan


def test_latest_by_methods_agree(spark):
    df = _skewed(spark)
    # duplicate timestamps for a tie on ts (broken by event_id)
    dup = df.limit(5).withColumn("event_id", F.col("event_id") + 100000)
    d = df.unionByName(dup)
    a = sorted(tuple(r) for r in latest_by(d).collect())
    b = sorted(tuple(r) for r in latest_by(d, method="sort").collect())
    c = sorted(tuple(r) for r in latest_by(d, max_keys=0).collect())
    assert a == b == c and len(a) == 4


def test_exclusive_prefix_sum_across_partitions(spark):
    from tankwise.operators.sequence import exclusive_prefix_sum
    import random
    rnd = random.Random(3)
    rows = [(f"K{i:04d}", rnd.randint(1, 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r["k"]: r["off"] for r in exclusive_prefix_sum(df, "k", "v", "off", partitions=7).collect()}
    run, exp = 0, {}
    for k, v in sorted(rows):
        exp[k] = run
        run += v
    assert got == exp


def test_halo_with_multi_day_buckets(spark):
    df = _skewed(spark, seed=11)
    c = halo_chunks(df, halo_rows=23, bucket_days=3)
    w = chunk_window()
    got = (c.withColumn("m", F.avg("speed").over(w.rowsBetween(-23, 0)))
             .withColumn("p", F.lag("fuel_level", 1).over(w))
             .filter(~F.col("_halo")).select("event_id", "m", "p"))
    nw = Window.partitionBy("equipment_id").orderBy("ts", "event_id")
    exp = df.select("event_id", F.avg("speed").over(nw.rowsBetween(-23, 0)).alias("m"),
                    F.lag("fuel_level", 1).over(nw).alias("p"))
    norm = lambda rows: {r[0]: (round(r[1], 9), r[2]) for r in rows}
    assert norm(got.collect()) == norm(exp.collect())


def hot_rows(spark, n=3000):
    """One unit, one day; a third of the rows at one instant; some keys missing."""
    rows = []
    for i in range(n):
        ts = dt.datetime(2024, 5, 1, 12) if i % 3 == 0 else dt.datetime(2024, 5, 1) + dt.timedelta(seconds=(i * 37) % 80000)
        rows.append((i, "EQ1" if i % 50 else None, ts if i % 61 else None, float(i % 97), float((i * 7) % 101)))
    return spark.createDataFrame(rows, "event_id long, equipment_id string, ts timestamp_ntz, fuel_level double, load_pct double")


def test_hot_day_is_cut_and_windows_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(SQ, "CHUNK_ROWS", 200)
    df = hot_rows(spark)
    c = SQ.halo_chunks(df, halo_rows=5)
    w = SQ.chunk_window().rowsBetween(-5, 0)
    got = (c.withColumns({"m": F.sum("load_pct").over(w), "p": F.lag("fuel_level").over(SQ.chunk_window())})
           .where("not _halo").select("event_id", "m", "p", "_n_key"))
    plain = Window.partitionBy("equipment_id").orderBy("ts", "event_id")
    want = df.select("event_id", F.sum("load_pct").over(plain.rowsBetween(-5, 0)).alias("m"),
                     F.lag("fuel_level").over(plain).alias("p"),
                     F.count("*").over(Window.partitionBy("equipment_id")).alias("_n_key"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    sizes = [r["count"] for r in c.where("equipment_id = 'EQ1' and not _halo").groupBy("_chunk").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 2 * 200


def test_split_keeps_rows_without_keys(spark, monkeypatch):
    monkeypatch.setattr(SQ, "CHUNK_ROWS", 200)
    df = hot_rows(spark, 1000)
    got = {r["event_id"]: r["is_train"] for r in SQ.ordered_split(df).collect()}
    order = [r["event_id"] for r in df.orderBy("equipment_id", "ts", "event_id").collect()]
    assert got == {e: k < 800 for k, e in enumerate(order)}


def test_only_large_units_have_halos_and_windows_stay_exact(spark, monkeypatch):
    t0 = dt.datetime(2024, 5, 1)
    rows = [(i, f"S{i % 4}" if i % 4 else None, t0 + dt.timedelta(days=i), float(i % 9), float(i % 7)) for i in range(400)]
    rows += [(1000 + i, "L", t0 + dt.timedelta(hours=i), float(i % 11), float(i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, equipment_id string, ts timestamp_ntz, fuel_level double, load_pct double")
    assert SQ.series_chunks(df).count() == len(rows)            # a reading a day: none is copied
    monkeypatch.setattr(SQ, "CHUNK_ROWS", 200)
    c = SQ.series_chunks(df, halo_rows=5)
    assert {r[0] for r in c.where("_halo").select("equipment_id").distinct().collect()} == {"L"}
    w, plain = SQ.chunk_window(), Window.partitionBy("equipment_id").orderBy("ts", "event_id")
    cols = lambda w: [F.sum("load_pct").over(w.rowsBetween(-5, 0)).alias("m"), F.lag("fuel_level").over(w).alias("p")]
    got = c.select("event_id", "_n_key", "_halo", *cols(w)).where("not _halo").drop("_halo")
    want = df.select("event_id", F.count("*").over(Window.partitionBy("equipment_id")), *cols(plain))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
