"""Registered jobs: serving views, summaries and filters (build steps 1 and 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tankwise.operators import anomaly as A
from tankwise.operators.sequence import PAGE, top_per_group
from tankwise.plans import views as V
from tankwise.plans.registry import TELEMETRY_DOUBLES, register, rnd, with_t
from tankwise.sources.store import ingest, store_folder, telemetry_store
from tankwise.sources.tables import telemetry
from tankwise.sources.versions import fingerprint

# Text fields of a reading: their SQL text is the same in both engines.
RECORD_TEXT = ["driver_id", "equipment_type", "gear", "driving_mode", "maintenance_status", "operational_status", "refuel_event",
               "event_notes", "location", "sensor_fault"]

LATEST_SQL = """SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY ts DESC, event_id DESC) AS rn FROM t
) WHERE rn = 1"""

# Unannotated-row 3-sigma bounds per type, wide (shared by several oracles).
SIGMA_CTE = """bounds AS (
  SELECT equipment_type,
    avg(fuel_consumed) AS fc_mu, stddev_samp(fuel_consumed) AS fc_sd,
    avg(fuel_efficiency) AS fe_mu, stddev_samp(fuel_efficiency) AS fe_sd,
    avg(engine_temp) AS et_mu, stddev_samp(engine_temp) AS et_sd,
    avg(oil_pressure) AS op_mu, stddev_samp(oil_pressure) AS op_sd
  FROM t WHERE (event_notes IS NULL OR length(event_notes) = 0) AND equipment_type IS NOT NULL
  GROUP BY equipment_type)"""
STAT_CTE = """stat AS (
  SELECT t.*, concat_ws(',',
      CASE WHEN fuel_consumed < fc_mu - 3e0 * fc_sd OR fuel_consumed > fc_mu + 3e0 * fc_sd THEN 'fuel_consumed' END,
      CASE WHEN fuel_efficiency < fe_mu - 3e0 * fe_sd OR fuel_efficiency > fe_mu + 3e0 * fe_sd THEN 'fuel_efficiency' END,
      CASE WHEN engine_temp < et_mu - 3e0 * et_sd OR engine_temp > et_mu + 3e0 * et_sd THEN 'engine_temp' END,
      CASE WHEN oil_pressure < op_mu - 3e0 * op_sd OR oil_pressure > op_mu + 3e0 * op_sd THEN 'oil_pressure' END
    ) AS stat_fired,
    coalesce(greatest(
      CASE WHEN fc_sd > 0 THEN abs(fuel_consumed - fc_mu) / fc_sd END,
      CASE WHEN fe_sd > 0 THEN abs(fuel_efficiency - fe_mu) / fe_sd END,
      CASE WHEN et_sd > 0 THEN abs(engine_temp - et_mu) / et_sd END,
      CASE WHEN op_sd > 0 THEN abs(oil_pressure - op_mu) / op_sd END), 0e0) AS max_abs_z
  FROM t JOIN bounds USING (equipment_type))"""


def stat_detections(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return A.detect_statistical(t, A.sigma_thresholds(A.unannotated(t)))


@register("latest_per_equipment", rnd(with_t(LATEST_SQL), TELEMETRY_DOUBLES))
def latest_per_equipment(spark, sf_dir):
    """WN1/WN2/WN12: latest reading per unit (hash max ts, counted broadcast semi join, tie on id)."""
    return V.latest_per_equipment(telemetry(spark, sf_dir))


@register("recent_events", rnd(with_t(
    "SELECT * FROM t WHERE ts >= (SELECT max(ts) FROM t) - INTERVAL 24 HOUR"), TELEMETRY_DOUBLES))
def recent_events(spark, sf_dir):
    """PRJ9/JN11: readings in the trailing 24 h (inclusive), from the last date folders of the store."""
    return V.recent_events(telemetry_store(spark, sf_dir))


@register("dashboard_summary", with_t("""
SELECT a.*, b.total_fuel_consumed, c.anomaly_count_24h, (SELECT max(ts) FROM t) AS last_updated
FROM (SELECT CAST(count(*) AS BIGINT) AS total_equipment,
             CAST(count_if(operational_status = 'Running') AS BIGINT) AS active_equipment,
             CAST(count_if(maintenance_status = 'Needs Service') AS BIGINT) AS maintenance_needed,
             CAST(count_if(fuel_level / tank_capacity < 2e-1) AS BIGINT) AS low_fuel_count
      FROM latest) a,
     (SELECT round(round_even(coalesce(sum(fuel_consumed), 0e0) * 1e2, 0) / 1e2, 4) AS total_fuel_consumed
      FROM t WHERE ts >= (SELECT max(ts) FROM t) - INTERVAL 24 HOUR) b,
     (SELECT CAST(count(*) AS BIGINT) AS anomaly_count_24h FROM stat
      WHERE length(stat_fired) > 0 AND ts >= (SELECT max(ts) FROM t) - INTERVAL 24 HOUR) c
""", "latest AS (" + LATEST_SQL + ")", SIGMA_CTE, STAT_CTE))
def dashboard_summary(spark, sf_dir):
    """VW6 summary: unit counts on latest rows, 24 h fuel, 24 h anomalies."""
    t = telemetry(spark, sf_dir)
    return V.dashboard_summary(t, telemetry_store(spark, sf_dir), A.sigma_thresholds(A.unannotated(t)))


@register("dashboard_equipment", rnd(with_t("""
SELECT equipment_id, equipment_type, operational_status,
       round_even(fuel_level / tank_capacity * 1e2 * 1e1, 0) / 1e1 AS fuel_level_pct, location, maintenance_status,
       (SELECT max(ts) FROM t) AS last_updated
FROM latest""", "latest AS (" + LATEST_SQL + ")"), ["fuel_level_pct"]))
def dashboard_equipment(spark, sf_dir):
    """VW6 per-unit status rows (the flagship entry query)."""
    return V.dashboard_equipment(telemetry(spark, sf_dir))


@register("equipment_list", with_t("""
SELECT equipment_id,
  coalesce(CAST(equipment_type AS VARCHAR), 'Data Not Available') AS equipment_type,
  coalesce(CAST(driver_id AS VARCHAR), 'Data Not Available') AS driver_id,
  coalesce(CAST(fuel_level AS VARCHAR), 'Data Not Available') AS fuel_level,
  coalesce(CAST(tank_capacity AS VARCHAR), 'Data Not Available') AS fuel_capacity,
  coalesce(CAST(operational_status AS VARCHAR), 'Data Not Available') AS operational_status,
  coalesce(CAST(maintenance_status AS VARCHAR), 'Data Not Available') AS maintenance_status,
  coalesce(CAST(location AS VARCHAR), 'Data Not Available') AS location
FROM latest""", "latest AS (" + LATEST_SQL + ")"))
def equipment_list(spark, sf_dir):
    """VW1: eight fields of each unit's latest row with the NULL sentinel."""
    return V.equipment_list(telemetry(spark, sf_dir))


@register("equipment_detail", rnd(with_t("""
SELECT l.equipment_id, l.ts AS latest_ts, l.equipment_type, l.fuel_level AS latest_fuel_level,
       l.operational_status, l.maintenance_status,
       h.history_points, h.history_start, h.avg_fuel_consumed, h.avg_fuel_efficiency, h.avg_load, h.avg_speed
FROM latest l JOIN (
  SELECT equipment_id, CAST(count(*) AS BIGINT) AS history_points, min(ts) AS history_start,
         avg(fuel_consumed) AS avg_fuel_consumed, avg(fuel_efficiency) AS avg_fuel_efficiency,
         avg(load_pct) AS avg_load, avg(speed) AS avg_speed
  FROM t GROUP BY equipment_id) h USING (equipment_id)""", "latest AS (" + LATEST_SQL + ")"),
    ["latest_fuel_level", "avg_fuel_consumed", "avg_fuel_efficiency", "avg_load", "avg_speed"]))
def equipment_detail(spark, sf_dir):
    """VW2: latest row + history summary, for every unit."""
    return V.equipment_detail(telemetry(spark, sf_dir))


@register("nested_payload", rnd(with_t(f"""
SELECT equipment_id, date, page, CAST(count(*) AS BIGINT) AS n_items,
       min(ts) AS first_ts, max(ts) AS last_ts, sum(fuel_consumed) AS sum_consumed,
       string_agg(strftime(ts, '%H:%M:%S') || '=' || CAST(round(fuel_consumed, 2) AS VARCHAR), ','
                  ORDER BY ts, event_id) AS rendered
FROM (SELECT *, CAST(ts AS DATE) AS date, CAST((row_number() OVER (PARTITION BY equipment_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1)
             // {PAGE} AS BIGINT) AS page FROM t)
GROUP BY equipment_id, date, page"""), ["sum_consumed"]))
def nested_payload(spark, sf_dir):
    """SNK5: ordered per-(unit, day, page) history arrays (flat summary compared)."""
    return V.nested_payload(telemetry(spark, sf_dir))


HISTORY_PAGE = 20        # small, so that most units have several pages


@register("equipment_history", rnd(with_t(f"""
SELECT equipment_id, CAST(position // {HISTORY_PAGE} AS BIGINT) AS page, CAST(position AS BIGINT) AS position, ts,
       {', '.join(V.HISTORY_COLUMNS)}
FROM (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY ts, event_id) - 1 AS position FROM t)"""), V.HISTORY_COLUMNS))
def equipment_history(spark, sf_dir):
    """VW2/SNK5: every unit's six-column history in pages of bounded arrays, exploded."""
    pages = V.equipment_history(telemetry(spark, sf_dir), HISTORY_PAGE)
    return pages.select("equipment_id", "page", F.explode("history").alias("h")).select("equipment_id", "page", "h.*")


@register("equipment_record", with_t(f"""
SELECT equipment_id, field, value FROM (
  SELECT equipment_id, unnest([{', '.join(f"'{c}'" for c in RECORD_TEXT)}]) AS field,
         unnest([{', '.join(f"coalesce(CAST({c} AS VARCHAR), 'Data Not Available')" for c in RECORD_TEXT)}]) AS value
  FROM latest)""", "latest AS (" + LATEST_SQL + ")"))
def equipment_record(spark, sf_dir):
    """VW2/PRJ15: the latest reading's fields as a map, NULL as the sentinel text; exploded."""
    wanted = F.map_filter("latest", lambda k, v: k.isin(RECORD_TEXT))
    return V.equipment_record(telemetry(spark, sf_dir)).select("equipment_id", F.explode(wanted).alias("field", "value"))


LOOKED_UP = ["EQ-0001", "EQ-0007", "EQ-0012", "no such unit"]


@register("equipment_lookup", rnd(with_t(f"""
SELECT a.equipment_id, CAST(count(t.event_id) AS BIGINT) AS readings, min(ts) AS first_ts, max(ts) AS latest_ts,
       max_by(fuel_level, ts) AS latest_fuel_level, count(t.event_id) > 0 AS found
FROM (SELECT unnest([{', '.join(f"'{i}'" for i in LOOKED_UP)}]) AS equipment_id) a LEFT JOIN t ON a.equipment_id = t.equipment_id
GROUP BY a.equipment_id"""), ["latest_fuel_level"]))
def equipment_lookup(spark, sf_dir):
    """PRJ7: a few units by id from the store (row groups skipped by range and Bloom filter)."""
    return V.equipment_lookup(telemetry_store(spark, sf_dir), LOOKED_UP)


@register("consumption_history", rnd(with_t("""
SELECT equipment_type, CAST(ts AS DATE) AS date, avg(fuel_consumed) AS fuel_consumed
FROM t WHERE ts >= (SELECT max(ts) FROM t) - INTERVAL 7 DAY AND equipment_type IS NOT NULL
GROUP BY equipment_type, CAST(ts AS DATE)"""), ["fuel_consumed"]))
def consumption_history(spark, sf_dir):
    """VW7/AG15: mean consumption per type and day over the trailing week."""
    return V.consumption_history(telemetry_store(spark, sf_dir), days=7)


@register("ingest_store", with_t("""
SELECT CAST(ts AS DATE) AS date, CAST(count(*) AS BIGINT) AS rows, min(ts) AS first_ts, max(ts) AS last_ts
FROM t GROUP BY CAST(ts AS DATE)"""))
def ingest_store(spark, sf_dir):
    """SRC1/SNK1: writes the date-partitioned store anew; rows and times of each date come from its footers."""
    folder = store_folder(spark, sf_dir)
    store = ingest(telemetry(spark, sf_dir), folder, fingerprint(spark, f"{sf_dir.rstrip('/')}/events.parquet"))
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")      # noqa: E731
    return store.stats.select("date", "rows", at("first").alias("first_ts"), at("last").alias("last_ts"))


@register("dataset_summary", with_t("""
SELECT min(ts) AS min_ts, max(ts) AS max_ts, CAST(count(DISTINCT equipment_id) AS BIGINT) AS n_equipment,
       CAST(count(*) AS BIGINT) AS n_rows FROM t"""))
def dataset_summary(spark, sf_dir):
    """AG12: time range, distinct units, rows."""
    return V.dataset_summary(telemetry(spark, sf_dir))


@register("distinct_types", with_t(
    "SELECT DISTINCT equipment_type FROM t WHERE equipment_type IS NOT NULL"))
def distinct_types(spark, sf_dir):
    """PRJ17: distinct equipment types."""
    return V.distinct_types(telemetry(spark, sf_dir))


@register("type_counts", with_t("""
SELECT equipment_type, CAST(count(*) AS BIGINT) AS n FROM t WHERE equipment_type IS NOT NULL
GROUP BY equipment_type"""))
def type_counts(spark, sf_dir):
    """AG16: value counts by type."""
    return V.type_counts(telemetry(spark, sf_dir))


@register("top_ids_per_type", with_t("""
SELECT equipment_type, equipment_id FROM (
  SELECT equipment_type, equipment_id,
         dense_rank() OVER (PARTITION BY equipment_type ORDER BY equipment_id) AS rk
  FROM (SELECT DISTINCT equipment_type, equipment_id FROM t)) WHERE rk <= 5"""))
def top_ids_per_type(spark, sf_dir):
    """WN11: at most five units per type (first ids in order)."""
    t = telemetry(spark, sf_dir).select("equipment_type", "equipment_id").distinct()
    return top_per_group(t, "equipment_type", "equipment_id", 5)


KNOWN_RX = "(?i)(theft|error|warning|Excessive|Unexpected|overheating)"
EXCLUDE_RX = "(?i)(anomaly|warning|error|theft|Excessive)"


@register("filter_known_anomalies", with_t(f"""
SELECT event_id, equipment_id, ts, event_notes FROM t
WHERE regexp_matches(coalesce(event_notes, ''), '{KNOWN_RX}')"""))
def filter_known_anomalies(spark, sf_dir):
    """PRJ10: notes matching the anomaly keywords, case-insensitive."""
    t = telemetry(spark, sf_dir).select("event_id", "equipment_id", "ts", "event_notes")
    return A.filter_keywords(t, A.KNOWN_ANOMALY_KEYWORDS)


@register("filter_normal_rows", with_t(f"""
SELECT event_id, equipment_id, ts, event_notes FROM t
WHERE NOT regexp_matches(coalesce(event_notes, ''), '{EXCLUDE_RX}')"""))
def filter_normal_rows(spark, sf_dir):
    """PRJ11: training rows without known-anomaly notes."""
    t = telemetry(spark, sf_dir).select("event_id", "equipment_id", "ts", "event_notes")
    return A.filter_keywords(t, A.TRAINING_EXCLUDE_KEYWORDS, negate=True)


@register("filter_unannotated", with_t("""
SELECT event_id, equipment_id, ts FROM t WHERE event_notes IS NULL OR length(event_notes) = 0"""))
def filter_unannotated(spark, sf_dir):
    """PRJ13: rows with empty or NULL notes."""
    return A.unannotated(telemetry(spark, sf_dir)).select("event_id", "equipment_id", "ts")


@register("min_group_filter", with_t("""
SELECT event_id, equipment_id, ts FROM t
WHERE equipment_id IN (SELECT equipment_id FROM t GROUP BY equipment_id HAVING count(*) >= 60)"""))
def min_group_filter(spark, sf_dir):
    """PRJ12: rows of groups with at least n rows (here: units with >= 60)."""
    t = telemetry(spark, sf_dir).select("event_id", "equipment_id", "ts")
    return A.min_group_filter(t, "equipment_id", 60)
