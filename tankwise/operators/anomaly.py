"""SQL-expressible anomaly detection (AG17, AG21, AG23, ML6-ML8, SC23).

The statistical detector joins per-type bounds (a table of #types rows,
counted before it is broadcast); rule typing is a pure projection plus one
lag, computed over the halo-chunked series so a hot unit is split by day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankwise.functions import scalar as S
from tankwise.operators.joins import join_checked
from tankwise.operators.sequence import DEFAULT_ORDER, PAGE, chunk_window, paged, positions, series_chunks
from tankwise.sources.store import last_before

# Fixed metric list of the 3-sigma detector.
SIGMA_METRICS = ["fuel_consumed", "fuel_efficiency", "engine_temp", "oil_pressure"]
# Fixed keyword patterns (case-insensitive) of annotated anomaly notes.
KNOWN_ANOMALY_KEYWORDS = ["theft", "error", "warning", "Excessive", "Unexpected", "overheating"]
TRAINING_EXCLUDE_KEYWORDS = ["anomaly", "warning", "error", "theft", "Excessive"]


def keyword_regex(words) -> str:
    return "(?i)(" + "|".join(words) + ")"


def filter_keywords(df: DataFrame, words=KNOWN_ANOMALY_KEYWORDS, col: str = "event_notes",
                    negate: bool = False) -> DataFrame:
    """PRJ10/PRJ11: case-insensitive alternation; NULL never matches."""
    m = F.coalesce(F.col(col), F.lit("")).rlike(keyword_regex(words))
    return df.filter(~m if negate else m)


def unannotated(df: DataFrame, col: str = "event_notes") -> DataFrame:
    """PRJ13 with defect Q2 fixed: NULL or empty notes."""
    return df.filter(F.col(col).isNull() | (F.length(F.col(col)) == 0))


def min_group_filter(df: DataFrame, group: str = "equipment_type", n: int = 50) -> DataFrame:
    """PRJ12: keep rows of groups with at least n rows (semi join on counts)."""
    big = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select(group)
    return join_checked(df, big, group, "left_semi")


def sigma_thresholds(df: DataFrame, group: str = "equipment_type", metrics=SIGMA_METRICS,
                     k: float = 3.0) -> DataFrame:
    """AG17: per type and metric mean, sample std and mean -/+ k std; nulls skipped."""
    present = [m for m in metrics if m in df.columns]
    long = (df.filter(F.col(group).isNotNull())
              .select(group, *[F.col(m).cast("double") for m in present])
              .unpivot(group, present, "metric", "value").filter(F.col("value").isNotNull()))
    g = long.groupBy(group, "metric").agg(F.avg("value").alias("mean"),
                                          F.stddev_samp("value").alias("std"),
                                          F.count(F.lit(1)).alias("n"))
    return g.withColumns({"lower": F.col("mean") - k * F.col("std"),
                          "upper": F.col("mean") + k * F.col("std"),
                          "n": F.col("n").cast("long")})


def _wide_bounds(thresholds: DataFrame, group: str, metrics) -> DataFrame:
    aggs = []
    for m in metrics:
        sel = F.col("metric") == m
        aggs += [F.max(F.when(sel, F.col("lower"))).alias(f"_{m}_lo"),
                 F.max(F.when(sel, F.col("upper"))).alias(f"_{m}_hi"),
                 F.max(F.when(sel, F.col("mean"))).alias(f"_{m}_mu"),
                 F.max(F.when(sel, F.col("std"))).alias(f"_{m}_sd")]
    return thresholds.groupBy(group).agg(*aggs)


def detect_statistical(df: DataFrame, thresholds: DataFrame, group: str = "equipment_type",
                       metrics=SIGMA_METRICS, how: str = "inner") -> DataFrame:
    """ML6: flag rows outside mean +- 3 std on any metric; types without
    bounds are dropped (JN9), or kept unflagged with ``how="left"``.  Adds ``stat_anomaly``, ``stat_fired`` and
    ``max_abs_z`` (largest standardised deviation)."""
    wide = _wide_bounds(thresholds, group, metrics)
    j = join_checked(df, wide, group, how)
    fired = [F.when((F.col(m) < F.col(f"_{m}_lo")) | (F.col(m) > F.col(f"_{m}_hi")), F.lit(m))
             for m in metrics]
    zs = [F.when(F.col(f"_{m}_sd") > 0, F.abs(F.col(m) - F.col(f"_{m}_mu")) / F.col(f"_{m}_sd"))
          for m in metrics]
    j = j.withColumns({
        "stat_fired": F.concat_ws(",", *fired),
        "max_abs_z": F.coalesce(F.greatest(*zs), F.lit(0.0)),
    }).withColumn("stat_anomaly", F.length("stat_fired") > 0)
    return j.drop(*[c for c in j.columns if c.startswith("_") and c.endswith(("_lo", "_hi", "_mu", "_sd"))])


# --------------------------------------------------------------- ML8
# Fixed anomaly type labels (the names the insight stage matches on).
ANOMALY_TYPES = ["Fuel Theft", "Efficiency", "Idle", "Sensor", "Engine Overheating",
                 "Excessive Load", "Oil Pressure"]


def rule_flags(prev_level="prev_level", expected="expected_consumption") -> dict:
    """Boolean rule columns (thresholds fixed by the injected signatures)."""
    lvl, cons = F.col("fuel_level"), F.col("fuel_consumed")
    x = F.col(prev_level) - cons
    theft = (F.col("refuel_event") != "Yes") & F.col(prev_level).isNotNull() & (x > 0) & (
        (x - lvl) >= 0.1 * x)
    eff = (F.col(expected) > 0) & (cons >= 1.3 * F.col(expected))
    idle = (F.col("idle_time") >= 45) & (F.col("speed") == 0)
    et, oil, bat = F.col("engine_temp"), F.col("oil_pressure"), F.col("battery_voltage")
    sensor = ((F.col("sensor_fault") > 0) | (et < -10) | (et >= 150) | (oil < 0) | (oil >= 100)
              | (bat <= 5) | (bat >= 18) | (F.col("rpm") >= 7000))
    overheat = (et > 100) & (et < 150)
    load = F.col("load_pct") >= 95
    oilp = (oil >= 0) & (oil < 20) & (F.col("operational_status") == "Running")
    return dict(zip(ANOMALY_TYPES, [theft, eff, idle, sensor, overheat, load, oilp]))


def with_prev_level(df: DataFrame, key: str = "equipment_id", order=DEFAULT_ORDER) -> DataFrame:
    c = series_chunks(df, key, order, halo_rows=1)
    w = chunk_window(key, order)
    out = c.withColumn("prev_level", F.lag("fuel_level", 1).over(w))
    return out.filter(~F.col("_halo")).drop("_halo", "_chunk", "_n_key")


def expected_columns(df: DataFrame, patterns: DataFrame) -> DataFrame:
    """SC21/SC22 over telemetry: base rates are the per-type profile means."""
    base = (patterns.filter(F.col("metric").isin("fuel_consumed", "emission_rate"))
                    .groupBy("equipment_type")
                    .agg(F.max(F.when(F.col("metric") == "fuel_consumed", F.col("mean"))).alias("base_consumption"),
                         F.max(F.when(F.col("metric") == "emission_rate", F.col("mean"))).alias("base_emission")))
    j = join_checked(df, base, "equipment_type", "left")
    month = F.month("ts")
    return j.withColumns({
        "expected_consumption": S.expected_consumption(F.col("base_consumption"), F.col("load_pct"),
                                                       F.col("speed"), F.col("idle_time") > 0, month),
        "expected_emission": S.expected_emission(F.col("base_emission"), F.col("load_pct"), month),
    })


def with_kinds(df: DataFrame, patterns: DataFrame, key: str = "equipment_id", prev=with_prev_level) -> DataFrame:
    """Every reading with the array ``kinds`` of the rule types it fires (empty if none);
    all columns of ``df`` are carried along, so other detectors' results need no join."""
    d = expected_columns(prev(df, key), patterns)
    kinds = F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in rule_flags().items()]))
    return d.withColumn("fuel_level_change", F.col("fuel_level") - F.col("prev_level")).withColumn("kinds", kinds)


def anomaly_rules(df: DataFrame, patterns: DataFrame, key: str = "equipment_id", prev=with_prev_level) -> DataFrame:
    """ML8: one output row per (reading, fired rule type)."""
    d = with_kinds(df, patterns, key, prev)
    return d.select(*[c for c in d.columns if c != "kinds"], F.explode("kinds").alias("anomaly_type"))


def anomaly_severity(rules: DataFrame) -> DataFrame:
    """SC23 applied to rule anomalies over rows that carry the statistical detector's
    ``max_abs_z``; score = min(1, max |z| / 5) (rows without bounds score 0)."""
    score = F.least(F.lit(1.0), F.coalesce(F.col("max_abs_z"), F.lit(0.0)) / 5.0)
    return rules.withColumn("anomaly_score", score).withColumn(
        "severity", S.severity(F.col("anomaly_type"), F.col("anomaly_score")))


def anomaly_rollup(rules: DataFrame, key: str = "equipment_id") -> DataFrame:
    """AG21: per (unit, type) count, total |level change|, sorted distinct
    locations (bounded by the site domain), first/last time."""
    return rules.groupBy(key, "anomaly_type").agg(
        F.count(F.lit(1)).cast("long").alias("anomaly_count"),
        F.sum(F.abs(F.coalesce(F.col("fuel_level_change"), F.lit(0.0)))).alias("total_missing"),
        F.array_join(F.sort_array(F.collect_set("location")), ",").alias("locations"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def anomaly_times(rules: DataFrame, key: str = "equipment_id", size: int = PAGE) -> DataFrame:
    """AG21, the times: per (unit, type, page) the ordered times of the anomalies."""
    d = rules.select(key, "anomaly_type", "ts", "event_id", F.struct(key, "anomaly_type").alias("_of"))
    return paged(positions(d, "_of"), [key, "anomaly_type"], ["ts", "event_id"], "times", size)


def union_detectors(stat: DataFrame, rules: DataFrame) -> DataFrame:
    """SE1: bag union of detector outputs in one long shape."""
    a = stat.filter("stat_anomaly").select("event_id", "equipment_id", "ts",
                                           F.lit("statistical").alias("detector"),
                                           F.col("stat_fired").alias("anomaly_type"))
    b = rules.select("event_id", "equipment_id", "ts", F.lit("rules").alias("detector"), "anomaly_type")
    return a.unionByName(b, allowMissingColumns=True)


def recent_rules(store, patterns: DataFrame, hours: int = 48) -> DataFrame:
    """VW4: rule anomalies of the trailing window.  Only its date folders are read, and
    for each unit in it one earlier reading, the one that the first lag looks at."""
    recent = store.trailing(hours=hours).drop("date")
    last = store.stats.agg(F.max("last")).first()[0]
    if last is None:
        return anomaly_rules(recent, patterns)
    cut = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=last) - dt.timedelta(hours=hours)
    before = last_before(store, cut, recent, ["equipment_id", "ts", "event_id", "fuel_level"])

    def prev(df, key):
        both = df.withColumn("_early", F.lit(False)).unionByName(before.withColumn("_early", F.lit(True)), allowMissingColumns=True)
        return with_prev_level(both, key).where(~F.col("_early")).drop("_early")
    return anomaly_rules(recent, patterns, prev=prev)
