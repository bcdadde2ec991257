"""Registered jobs: SQL-expressible anomaly detection (build step 7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tankwise.operators import anomaly as A
from tankwise.operators import patterns as P
from tankwise.plans.q_patterns import EXPECTED_CTE, PATTERNS_CTE
from tankwise.plans.q_views import SIGMA_CTE, STAT_CTE, stat_detections
from tankwise.plans.registry import register, rnd, with_t
from tankwise.sources.store import telemetry_store
from tankwise.sources.tables import telemetry

# SQL text of the ML8 rules (same thresholds as operators.anomaly.rule_flags).
RULE_CASES = [
    ("Fuel Theft", "refuel_event <> 'Yes' AND prev_level IS NOT NULL AND prev_level - fuel_consumed > 0 "
                   "AND (prev_level - fuel_consumed) - fuel_level >= 1e-1 * (prev_level - fuel_consumed)"),
    ("Efficiency", "expected_consumption > 0 AND fuel_consumed >= 1.3e0 * expected_consumption"),
    ("Idle", "idle_time >= 45 AND speed = 0"),
    ("Sensor", "sensor_fault > 0 OR engine_temp < -10 OR engine_temp >= 150 OR oil_pressure < 0 "
               "OR oil_pressure >= 100 OR battery_voltage <= 5 OR battery_voltage >= 18 OR rpm >= 7000"),
    ("Engine Overheating", "engine_temp > 100 AND engine_temp < 150"),
    ("Excessive Load", "load_pct >= 95"),
    ("Oil Pressure", "oil_pressure >= 0 AND oil_pressure < 20 AND operational_status = 'Running'"),
]
RULE_LIST = "[" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in RULE_CASES) + "]"
RULES_CTE = f"""prev AS (SELECT event_id, lag(fuel_level) OVER (PARTITION BY equipment_id ORDER BY ts, event_id)
                 AS prev_level FROM t),
rules AS (
  SELECT * EXCLUDE (kinds) FROM (
    SELECT e.*, p.prev_level, e.fuel_level - p.prev_level AS fuel_level_change,
      list_filter({RULE_LIST.replace('prev_level', 'p.prev_level')}, lambda k: k IS NOT NULL) AS kinds
    FROM expected e JOIN prev p USING (event_id)) x,
  LATERAL (SELECT unnest(x.kinds) AS anomaly_type))"""
RULE_CTES = (PATTERNS_CTE, EXPECTED_CTE, RULES_CTE)


def rules_df(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return A.anomaly_rules(t, P.equipment_patterns(t))


def detected(spark, sf_dir):
    """Every reading with both detectors' results, in one pass over the series."""
    t = telemetry(spark, sf_dir)
    rows = A.detect_statistical(t, A.sigma_thresholds(A.unannotated(t)), how="left")
    return A.with_kinds(rows, P.equipment_patterns(t))


SIGMA_SQL = """
SELECT equipment_type, metric, avg(value) AS mean, stddev_samp(value) AS std, CAST(count(*) AS BIGINT) AS n,
  avg(value) - 3e0 * stddev_samp(value) AS lower, avg(value) + 3e0 * stddev_samp(value) AS upper
FROM (UNPIVOT (SELECT equipment_type, fuel_consumed, fuel_efficiency, engine_temp, oil_pressure FROM t
               WHERE (event_notes IS NULL OR length(event_notes) = 0) AND equipment_type IS NOT NULL)
      ON fuel_consumed, fuel_efficiency, engine_temp, oil_pressure INTO NAME metric VALUE value)
GROUP BY equipment_type, metric"""


@register("sigma_thresholds", rnd(with_t(SIGMA_SQL), ["mean", "std", "lower", "upper"]))
def sigma_thresholds(spark, sf_dir):
    """AG17: 3-sigma bounds per type and metric over unannotated rows."""
    return A.sigma_thresholds(A.unannotated(telemetry(spark, sf_dir)))


@register("detect_statistical", rnd(with_t(
    "SELECT event_id, equipment_id, ts, stat_fired, max_abs_z, length(stat_fired) > 0 AS stat_anomaly FROM stat",
    SIGMA_CTE, STAT_CTE), ["max_abs_z"]))
def detect_statistical(spark, sf_dir):
    """ML6: rows outside mean +- 3 std on any metric (fully SQL)."""
    return stat_detections(spark, sf_dir).select("event_id", "equipment_id", "ts", "stat_fired",
                                                 "max_abs_z", "stat_anomaly")


@register("anomaly_rules", rnd(with_t(
    "SELECT event_id, equipment_id, equipment_type, ts, anomaly_type, location, fuel_level_change FROM rules",
    *RULE_CTES), ["fuel_level_change"]))
def anomaly_rules(spark, sf_dir):
    """ML8: rule-based anomaly typing, one row per (reading, type)."""
    return rules_df(spark, sf_dir).select("event_id", "equipment_id", "equipment_type", "ts", "anomaly_type",
                                          "location", "fuel_level_change")


@register("union_detectors", with_t("""
SELECT event_id, equipment_id, ts, 'statistical' AS detector, stat_fired AS anomaly_type FROM stat
WHERE length(stat_fired) > 0
UNION ALL
SELECT event_id, equipment_id, ts, 'rules' AS detector, anomaly_type FROM rules""",
    SIGMA_CTE, STAT_CTE, *RULE_CTES))
def union_detectors(spark, sf_dir):
    """SE1: bag union of statistical and rule detections."""
    return A.union_detectors(stat_detections(spark, sf_dir), rules_df(spark, sf_dir))


@register("anomaly_count", with_t("""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM stat WHERE length(stat_fired) > 0) AS n_statistical,
       (SELECT CAST(count(*) AS BIGINT) FROM rules) AS n_rule_rows,
       (SELECT CAST(count(DISTINCT event_id) AS BIGINT) FROM rules) AS n_rule_events""",
    SIGMA_CTE, STAT_CTE, *RULE_CTES))
def anomaly_count(spark, sf_dir):
    """AG23: number of detected anomalies per detector."""
    d = detected(spark, sf_dir)
    return d.agg(F.count_if("stat_anomaly").cast("long").alias("n_statistical"),
                 F.coalesce(F.sum(F.size("kinds")), F.lit(0)).cast("long").alias("n_rule_rows"),
                 F.count_distinct(F.when(F.size("kinds") > 0, F.col("event_id"))).cast("long").alias("n_rule_events"))


ROLLUP_CTE = """rollup AS (
  SELECT equipment_id, anomaly_type, CAST(count(*) AS BIGINT) AS anomaly_count,
    sum(abs(coalesce(fuel_level_change, 0e0))) AS total_missing,
    string_agg(DISTINCT location, ',' ORDER BY location) AS locations, min(ts) AS first_ts, max(ts) AS last_ts
  FROM rules GROUP BY equipment_id, anomaly_type)"""


@register("anomaly_rollup", rnd(with_t("SELECT * FROM rollup", *RULE_CTES, ROLLUP_CTE), ["total_missing"]))
def anomaly_rollup(spark, sf_dir):
    """AG21: per (unit, type) count, total missing fuel, locations, first/last time."""
    return A.anomaly_rollup(rules_df(spark, sf_dir))


@register("anomaly_times", with_t("""
SELECT equipment_id, anomaly_type, CAST(position // 10 AS BIGINT) AS page, CAST(position AS BIGINT) AS position, ts, event_id
FROM (SELECT *, row_number() OVER (PARTITION BY equipment_id, anomaly_type ORDER BY ts, event_id) - 1 AS position FROM rules)""",
    *RULE_CTES))
def anomaly_times(spark, sf_dir):
    """AG21: the ordered times of each (unit, type) in pages of bounded arrays, exploded."""
    pages = A.anomaly_times(rules_df(spark, sf_dir), size=10)
    return pages.select("equipment_id", "anomaly_type", "page", F.explode("times").alias("x")).select(
        "equipment_id", "anomaly_type", "page", "x.*")


@register("anomaly_severity", rnd(with_t("""
SELECT r.event_id, r.anomaly_type, least(1e0, coalesce(s.max_abs_z, 0e0) / 5e0) AS anomaly_score,
  CASE GREATEST(
         CASE WHEN least(1e0, coalesce(s.max_abs_z, 0e0) / 5e0) >= 8e-1 THEN 3
              WHEN least(1e0, coalesce(s.max_abs_z, 0e0) / 5e0) >= 6e-1 THEN 2
              WHEN least(1e0, coalesce(s.max_abs_z, 0e0) / 5e0) >= 4e-1 THEN 1 ELSE 0 END,
         CASE WHEN contains(r.anomaly_type, 'Theft') OR contains(r.anomaly_type, 'Oil')
                   OR contains(r.anomaly_type, 'Overheat') THEN 2 ELSE 0 END)
    WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity
FROM rules r LEFT JOIN stat s USING (event_id)""", SIGMA_CTE, STAT_CTE, *RULE_CTES), ["anomaly_score"]))
def anomaly_severity(spark, sf_dir):
    """SC23: severity by score band, theft/oil/overheat at least high."""
    out = A.anomaly_severity(detected(spark, sf_dir).withColumn("anomaly_type", F.explode("kinds")))
    return out.select("event_id", "anomaly_type", "anomaly_score", "severity")


@register("anomalies_48h", rnd(with_t("""
SELECT event_id, equipment_id, ts, anomaly_type, fuel_consumed, fuel_level FROM rules
WHERE ts >= (SELECT max(ts) FROM t) - INTERVAL 48 HOUR""", *RULE_CTES), ["fuel_consumed", "fuel_level"]))
def anomalies_48h(spark, sf_dir):
    """VW4: rule anomalies in the trailing 48 h (six fields)."""
    r = A.recent_rules(telemetry_store(spark, sf_dir), P.equipment_patterns(telemetry(spark, sf_dir)), 48)
    return r.select("event_id", "equipment_id", "ts", "anomaly_type",
                                               "fuel_consumed", "fuel_level")


@register("unfaulted_rows", with_t("""
SELECT event_id, equipment_id, ts FROM t
WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.event_id = t.event_id)""", *RULE_CTES))
def unfaulted_rows(spark, sf_dir):
    """JN12/SE3: readings no rule flagged (empty array of rule types, in the pass that fills it)."""
    t = telemetry(spark, sf_dir)
    return A.with_kinds(t, P.equipment_patterns(t)).where(F.size("kinds") == 0).select("event_id", "equipment_id", "ts")
