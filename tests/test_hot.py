"""Operators that one value, unit or day could load onto one task."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from support import SF_SMALL
from tankwise.operators import features as FE
from tankwise.operators import patterns as P
from tankwise.operators import selection as SEL
from tankwise.operators import sequence as SQ
from tankwise.sources.tables import economy


# ------------------------------------------------------------ exact selection
def _values(kind):
    rng = random.Random(kind)
    return {"even": [rng.random() for _ in range(3000)], "odd": [rng.gauss(0, 1e6) for _ in range(3001)],
            "ties": [float(rng.randint(0, 5)) for _ in range(2500)], "one value": [7.0] * 900,
            "heavy middle": [1.0] * 700 + [2.0] * 700 + [rng.random() for _ in range(10)],
            "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(2000)],
            "two": [3.0, 4.0], "one": [5.0], "none": []}[kind]


@pytest.mark.parametrize("kind", ["even", "odd", "ties", "one value", "heavy middle", "wide", "two", "one", "none"])
def test_exact_median(spark, monkeypatch, kind):
    monkeypatch.setattr(SEL, "FEW", 20)
    monkeypatch.setattr(SEL, "BINS", 12)
    v = _values(kind)
    df = spark.createDataFrame([(x,) for x in [*v, None, float("nan")]], "x double").repartition(5)
    n, median = SEL.exact_median(df, "x")
    assert n == len(v) and median == (statistics.median(v) if v else None)
    for k in {k for k in (1, len(v) // 3, len(v)) if 0 < k <= len(v)}:
        value, upto = SEL.kth_smallest(df, "x", k)
        assert value == sorted(v)[k - 1] and upto == sum(x <= value for x in v)


def test_the_unit_decision_sorts_nothing(spark):
    for df in (P.unit_detection(economy(spark, SF_SMALL), "comb08"), P.unit_flag(economy(spark, SF_SMALL), "comb08")):
        plan = df._jdf.queryExecution().toString()
        assert "median(" not in plan and "percentile" not in plan and "Sort" not in plan


# ------------------------------------------------------------ range frame of a hot day
def _naive(rows):
    out = {}
    for i, unit, ts, load in rows:
        frame = [x for _, u, t, x in rows if u == unit and x is not None
                 and (t is None and ts is None or t is not None and ts is not None and ts - dt.timedelta(hours=3) <= t <= ts)]
        out[i] = sum(frame) / len(frame) if frame else None
    return out


def test_a_hot_day_is_answered_by_slices(spark, monkeypatch):
    monkeypatch.setattr(SQ, "CHUNK_ROWS", 40)
    rng, t0 = random.Random(1), dt.datetime(2024, 5, 1)
    rows = [(i, "hot", t0 + dt.timedelta(seconds=rng.randint(0, 90_000)), float(rng.randint(0, 100))) for i in range(600)]
    rows += [(1000 + i, "hot", t0 + dt.timedelta(hours=5), 10.0 * (i % 3)) for i in range(150)]          # one instant
    rows += [(2000 + i, "cold", t0 + dt.timedelta(minutes=40 * i), float(i)) for i in range(30)]
    rows += [(3000, "hot", t0 + dt.timedelta(days=3), None), (3001, "hot", None, 4.0), (3002, "hot", None, 8.0), (3003, None, t0, 5.0)]
    df = spark.createDataFrame(rows, "event_id long, equipment_id string, ts timestamp_ntz, load_pct double").repartition(6)
    got = {r["event_id"]: r["avg_load_3h"] for r in FE.with_avg_load_3h(df).collect()}
    want = _naive(rows)
    assert set(got) == set(want)
    assert all(got[i] == pytest.approx(want[i], rel=1e-12, abs=1e-12) if want[i] is not None else got[i] is None for i in want)


def test_slices_of_a_hot_day_are_many_and_small(spark, monkeypatch):
    monkeypatch.setattr(SQ, "CHUNK_ROWS", 50)
    df = spark.range(4000).select(F.col("id").alias("event_id"), F.lit("hot").alias("equipment_id"),
                                  (F.lit("2024-05-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 20)).alias("ts"),
                                  (F.col("id") % 100).cast("double").alias("load_pct"))
    seen = []
    real = SQ.with_buckets

    def spy(d, key, order, *a):
        out = real(d, key, order, *a)
        seen.append([r["count"] for r in out.groupBy(key, "_b").count().collect()])
        return out
    monkeypatch.setattr(SQ, "with_buckets", spy)
    out = FE.with_avg_load_3h(df)
    assert out.count() == 4000
    assert len(seen[0]) > 60 and max(seen[0]) < 400


# ------------------------------------------------------------ pages
@pytest.mark.parametrize("per_day", [False, True])
def test_pages_hold_a_hot_unit_in_bounded_arrays(spark, monkeypatch, per_day):
    monkeypatch.setattr(SQ, "CHUNK_ROWS", 60)
    rng, t0 = random.Random(2), dt.datetime(2024, 5, 1)
    rows = [(i, "hot", t0 + dt.timedelta(seconds=rng.randint(0, 200_000))) for i in range(1500)]
    rows += [(5000 + i, "hot", t0) for i in range(200)] + [(6000 + i, f"u{i % 3}", t0 + dt.timedelta(hours=i)) for i in range(50)]
    rows += [(7000, "hot", None), (7001, None, t0), (7002, None, None)]
    df = spark.createDataFrame(rows, "event_id long, equipment_id string, ts timestamp_ntz").repartition(5)
    numbered = SQ.positions(df, per_day=per_day).withColumn("date", F.to_date("ts"))
    keys = ["equipment_id", "date"] if per_day else ["equipment_id"]
    pages = SQ.paged(numbered, keys, ["ts", "event_id"], "items", size=70)
    assert max(len(r["items"]) for r in pages.collect()) == 70
    low = dt.datetime.min
    want, got = {}, {}
    for i, unit, ts in sorted(rows, key=lambda r: (r[2] or low, r[0])):
        want.setdefault((unit, ts.date() if ts and per_day else None), []).append(i)
    for r in sorted(pages.collect(), key=lambda r: r["page"]):
        out = got.setdefault((r["equipment_id"], r["date"] if per_day else None), [])
        assert r["page"] * 70 == len(out) and [x["position"] for x in r["items"]] == list(range(len(out), len(out) + len(r["items"])))
        out += [x["event_id"] for x in r["items"]]
    assert got == want
    table = {tuple(r)[:-2]: (r["entries"], r["pages"]) for r in SQ.page_table(numbered, keys, 70).collect()}
    assert all(v[1] == -(-v[0] // 70) for v in table.values()) and sum(v[0] for v in table.values()) == len(rows)


def test_a_day_can_need_more_than_256_buckets(spark, monkeypatch):
    monkeypatch.setattr(SQ, "CHUNK_ROWS", 10)
    df = spark.range(9_000).select(F.col("id").alias("event_id"), F.lit("hot").alias("equipment_id"),
                                   (F.lit("2024-05-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 9)).alias("ts"))
    sizes = [r["count"] for r in SQ.with_buckets(df, "equipment_id", ("ts", "event_id")).groupBy("_b").count().collect()]
    assert len(sizes) > 600 and max(sizes) <= 30 and sum(sizes) == 9_000
    got = {r["event_id"]: r["position"] for r in SQ.positions(df).collect()}
    assert got == {i: i for i in range(9_000)}
