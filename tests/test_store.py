"""Date-partitioned store: footers, pruned trailing windows, look-back, versions."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from support import SF_SMALL, files_read, rows_scanned
from tankwise.operators import anomaly as A
from tankwise.operators import patterns as P
from tankwise.plans import views as V
from tankwise.session import scratch_path, settings
from tankwise.sources import store as S
from tankwise.sources.tables import table, telemetry
from tankwise.sources.versions import Log, fingerprint, write_text_once


@pytest.fixture(scope="module")
def store(spark):
    return S.telemetry_store(spark, SF_SMALL)


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_footers_give_the_date_table(spark, store):
    with settings(spark, S.FOOTERS):
        plan = _plan(S.footer_query(spark, store.path, store.schema))
    assert "PushedAggregation: [COUNT(*), MIN(ts_us), MAX(ts_us)]" in plan and "PushedGroupBy: [date]" in plan
    want = {r["d"]: (r["n"], r["hi"]) for r in telemetry(spark, SF_SMALL).groupBy(F.to_date("ts").alias("d"))
            .agg(F.count("*").alias("n"), F.max("ts").alias("hi")).collect()}
    got = {r["date"]: (r["rows"], r["hi"]) for r in store.stats.withColumn(
        "hi", F.timestamp_micros("last").cast("timestamp_ntz")).collect()}
    assert got == want


def test_trailing_windows_read_the_last_dates_only(spark, store):
    everything = files_read(store.rows)
    for df, days in ((V.recent_events(store), 2), (V.consumption_history(store), 8), (store.trailing(hours=48), 3)):
        assert files_read(df) <= days < everything
        assert re.search(r"PartitionFilters: \[isnotnull\(date#\d+\), \(date#\d+ >= cast\(\w*\s*[sS]ubquery", _plan(df))


def test_cut_is_inclusive_and_rows_without_a_time_stay_out(spark):
    t0 = dt.datetime(2024, 3, 1, 12)
    rows = [(i, "EQ-1", t0 - dt.timedelta(hours=h)) for i, h in enumerate([0, 24, 24.001, 48])] + [(9, "EQ-1", None)]
    df = spark.createDataFrame(rows, "event_id long, equipment_id string, ts timestamp_ntz")
    st = S.ingest(df, scratch_path(spark, "store"), "x")
    assert sorted(r["event_id"] for r in st.trailing(hours=24).collect()) == [0, 1]
    assert sorted(r["event_id"] for r in st.rows.collect()) == [0, 1, 2, 3, 9]


def test_an_empty_table_has_an_empty_store(spark):
    df = spark.createDataFrame([], "event_id long, equipment_id string, ts timestamp_ntz, fuel_level double")
    st = S.ingest(df, scratch_path(spark, "store"), "x")
    assert st.stats.count() == 0


def test_a_hot_day_is_spread_over_files(spark):
    df = spark.range(40_000).select(F.col("id").alias("event_id"), F.lit("EQ-1").alias("equipment_id"),
                                    (F.lit("2024-01-05 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("ts"))
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        st = S.ingest(df.where("ts < '2024-01-06'"), scratch_path(spark, "store"), "x")
    assert st.stats.count() == 1 and files_read(st.rows) >= 6


def test_look_back_finds_each_units_last_row(spark, store):
    cut = dt.datetime(2024, 1, 29)
    t = telemetry(spark, SF_SMALL)
    units = t.select("equipment_id").unionAll(spark.createDataFrame([("EQ-none",), (None,)], "equipment_id string"))
    got = S.last_before(store, cut, units, ["equipment_id", "ts", "event_id", "fuel_level"])
    want = {}
    for r in t.where(F.col("ts") < F.lit(cut)).collect():
        old = want.get(r["equipment_id"])
        if old is None or (r["ts"], r["event_id"]) > old[:2]:
            want[r["equipment_id"]] = (r["ts"], r["event_id"], r["fuel_level"])
    assert {r["equipment_id"]: tuple(r)[1:] for r in got.collect()} == want


def test_recent_rules_equal_the_whole_history(spark, store):
    t = telemetry(spark, SF_SMALL)
    patterns = P.equipment_patterns(t)
    for hours in (6, 48, 24 * 40):
        cut = t.agg(F.max("ts")).first()[0] - dt.timedelta(hours=hours)
        whole = A.anomaly_rules(t, patterns).where(F.col("ts") >= F.lit(cut).cast("timestamp_ntz"))
        a, b = [sorted((r["event_id"], r["anomaly_type"], r["fuel_level_change"]) if r["fuel_level_change"] is not None
                       else (r["event_id"], r["anomaly_type"], 0.0) for r in x.collect())
                for x in (whole, A.recent_rules(store, patterns, hours))]
        assert a == b


def test_resent_rows_do_not_multiply(spark):
    t = telemetry(spark, SF_SMALL)
    twice = t.unionAll(t.where("event_id % 7 = 0"))
    bounds, patterns = A.sigma_thresholds(A.unannotated(t)), P.equipment_patterns(t)
    rows = A.with_kinds(A.detect_statistical(twice, bounds, how="left"), patterns)
    out = A.anomaly_severity(rows.withColumn("anomaly_type", F.explode("kinds")))
    n = rows.agg(F.sum(F.size("kinds"))).first()[0]
    assert out.count() == n


def test_a_changed_table_is_ingested_again(spark):
    path = scratch_path(spark, "tables")
    ev = table(spark, SF_SMALL, "events")
    ev.where("event_id % 2 = 0").write.parquet(f"{path}/events.parquet")
    first = S.telemetry_store(spark, path)
    assert S.telemetry_store(spark, path).path == first.path
    ev.where("event_id % 2 = 1").write.mode("append").parquet(f"{path}/events.parquet")
    second = S.telemetry_store(spark, path)
    assert second.path != first.path
    assert second.rows.count() == ev.count() and first.rows.count() == ev.where("event_id % 2 = 0").count()


def test_versions_are_whole_and_never_overwritten(spark):
    folder = scratch_path(spark, "log")
    log = Log(spark, folder)
    assert log.latest() == (-1, None)
    assert log.commit(0, {"a": 1}) and not log.commit(0, {"a": 2})
    assert log.add({"a": 3}) == 1 and log.latest() == (1, {"a": 3}) and log.read(0) == {"a": 1}
    assert not write_text_once(spark, f"{folder}/000000000001.json", "x")
    assert fingerprint(spark, folder) == fingerprint(spark, folder)


def test_a_lookup_reads_the_units_row_groups_only(spark):
    """Small row groups stand for the large files of a large store."""
    df = spark.range(60_000).select(
        F.col("id").alias("event_id"), F.format_string("EQ-%04d", F.col("id") % 600).alias("equipment_id"),
        (F.lit("2024-01-05 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("ts"),
        F.rand(1).alias("fuel_level"))
    path = scratch_path(spark, "store")
    S.write_store(df, path, row_group=4_096)
    rows = spark.read.parquet(path)
    hit = rows.where("equipment_id = 'EQ-0123'")
    assert rows_scanned(rows) == 60_000
    assert hit.count() == 100 and 100 <= rows_scanned(hit) < 15_000
    assert "PushedFilters: [IsNotNull(equipment_id), EqualTo(equipment_id,EQ-0123)]" in _plan(hit)


def test_lookup_says_what_is_not_there(spark, store):
    got = {r["equipment_id"]: r for r in V.equipment_lookup(store, ["EQ-0001", "EQ-0001", "nobody"]).collect()}
    assert set(got) == {"EQ-0001", "nobody"}
    assert not got["nobody"]["found"] and got["nobody"]["readings"] == 0 and got["nobody"]["latest_ts"] is None
    t = telemetry(spark, SF_SMALL).where("equipment_id = 'EQ-0001'")
    assert got["EQ-0001"]["readings"] == t.count() and got["EQ-0001"]["latest_ts"] == t.agg(F.max("ts")).first()[0]
