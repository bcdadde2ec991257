"""Registered jobs: ingest round trips (build step 2).

Each job first writes files in the reference's shape -- derived from the
provided tables, so the work grows with them -- into a fresh folder under the
shared checkpoint directory, then reads them back with the source reader.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tankwise.operators import features as FE
from tankwise.operators import patterns as P
from tankwise.plans.q_patterns import CAL_CTE, HOURLY_CTE, PCT_CTE
from tankwise.plans.registry import (ECONOMY_CTE, RATINGS_CTE, TELEMETRY_DOUBLES, register, rnd,
                                     with_ctes, with_t)
from tankwise.session import scratch_path
from tankwise.sources import files as SF
from tankwise.sources.tables import economy, fuel_ratings, table, telemetry

TELEMETRY_COLUMNS = [canon for _, canon, _ in SF.TELEMETRY_SOURCE_COLUMNS]
FILE_CTE = """f AS (SELECT *, avg(load_pct) OVER (PARTITION BY equipment_id ORDER BY ts
  RANGE BETWEEN INTERVAL 3 HOUR PRECEDING AND CURRENT ROW) AS avg_load_3h FROM t)"""
FILE_DOUBLES = [*TELEMETRY_DOUBLES, "avg_load_3h"]


def _stage_telemetry(spark, sf_dir, dirty: bool = False):
    t = FE.with_avg_load_3h(telemetry(spark, sf_dir)).select(*TELEMETRY_COLUMNS, "event_id")
    path = scratch_path(spark, "telemetry-csv")
    if dirty:
        # Fixture dirt: unparseable and non-finite text in numeric fields.
        t = t.withColumns({
            "rpm": F.when(F.col("event_id") % 97 == 0, F.lit("NaN")).otherwise(F.col("rpm").cast("string")),
            "load_pct": F.when(F.col("event_id") % 89 == 0, F.lit("n/a")).otherwise(F.col("load_pct").cast("string")),
            "speed": F.when(F.col("event_id") % 83 == 0, F.lit("Infinity")).otherwise(F.col("speed").cast("string")),
        })
    SF.write_telemetry_csv(t, path)
    return path


@register("src_telemetry", rnd(with_t(f"SELECT {', '.join(TELEMETRY_COLUMNS)}, event_id FROM f", FILE_CTE), FILE_DOUBLES))
def src_telemetry(spark, sf_dir):
    """SRC1/SNK1: telemetry CSV (source headers) written, then read by header names."""
    path = _stage_telemetry(spark, sf_dir)
    return SF.read_telemetry_csv(spark, path, include_key=True)


@register("ingest_clean", rnd(with_t(f"""
SELECT * REPLACE (
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE rpm END AS rpm,
  CASE WHEN event_id % 89 = 0 THEN NULL ELSE load_pct END AS load_pct,
  CASE WHEN event_id % 83 = 0 THEN NULL ELSE speed END AS speed)
FROM (SELECT {', '.join(TELEMETRY_COLUMNS)}, event_id FROM f)""", FILE_CTE), FILE_DOUBLES))
def ingest_clean(spark, sf_dir):
    """PRJ6/PRJ14: all-string read, try_cast to canonical types, NaN/inf/junk -> NULL."""
    path = _stage_telemetry(spark, sf_dir, dirty=True)
    return SF.ingest_clean(SF.read_telemetry_raw(spark, path, include_key=True))


AUTO_SQL = """
SELECT l_quantity AS mpg, CAST(l_linenumber + 2 AS INTEGER) AS cylinders,
  CAST(70 + l_partkey % 400 AS DOUBLE) AS displacement, CAST(40 + l_suppkey % 200 AS DOUBLE) AS horsepower,
  CAST(1500 + (l_orderkey * 7) % 3500 AS DOUBLE) AS weight, CAST(8 + l_linenumber * 2 AS DOUBLE) AS acceleration,
  CAST(70 + l_orderkey % 13 AS INTEGER) AS model_year, CAST(1 + l_suppkey % 3 AS INTEGER) AS origin,
  concat('car ', l_returnflag, l_linestatus, ' ', CAST(l_orderkey AS VARCHAR)) AS car_name,
  CAST(1500 + (l_orderkey * 7) % 3500 AS DOUBLE) * 4.53592e-1 AS weight_kg,
  l_quantity * 4.25e-1 AS fuel_efficiency_km_per_l,
  CASE WHEN l_quantity <> 0 THEN 6e1 / (l_quantity * 4.25e-1) END AS fuel_consumption_l_per_hr
FROM lineitem WHERE l_orderkey % 17 <> 0 AND l_quantity IS NOT NULL"""


@register("src_auto_mpg", rnd(AUTO_SQL, ["mpg", "displacement", "horsepower", "weight", "acceleration",
                                          "weight_kg", "fuel_efficiency_km_per_l", "fuel_consumption_l_per_hr"]))
def src_auto_mpg(spark, sf_dir):
    """SRC2/PRJ16: auto-MPG text layout ('?' = missing) parsed, coerced, NULL rows dropped."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.col("l_quantity").cast("string").alias("mpg"),
        (F.col("l_linenumber") + 2).cast("string").alias("cylinders"),
        (70 + F.col("l_partkey") % 400).cast("double").cast("string").alias("displacement"),
        F.when(F.col("l_orderkey") % 17 == 0, F.lit("?"))
         .otherwise((40 + F.col("l_suppkey") % 200).cast("double").cast("string")).alias("horsepower"),
        (1500 + (F.col("l_orderkey") * 7) % 3500).cast("double").cast("string").alias("weight"),
        (8 + F.col("l_linenumber") * 2).cast("double").cast("string").alias("acceleration"),
        (70 + F.col("l_orderkey") % 13).cast("string").alias("model_year"),
        (1 + F.col("l_suppkey") % 3).cast("string").alias("origin"),
        F.concat(F.lit("car "), F.col("l_returnflag"), F.col("l_linestatus"), F.lit(" "),
                 F.col("l_orderkey").cast("string")).alias("car_name"))
    path = scratch_path(spark, "auto-mpg")
    SF.write_auto_mpg(rows, path)
    return SF.read_auto_mpg(spark, path)


@register("src_vehicle_economy", rnd(with_ctes(
    "SELECT " + ", ".join(P.ECONOMY_COLUMNS) + " FROM econ", ECONOMY_CTE), ["displ", "city08", "highway08", "comb08"]))
def src_vehicle_economy(spark, sf_dir):
    """SRC3/PRJ1: economy CSV with explicit schema, expected columns kept."""
    path = scratch_path(spark, "economy-csv")
    SF.write_csv(economy(spark, sf_dir), path)
    return P.select_existing(SF.read_csv_with_schema(spark, path, SF.ECONOMY_SCHEMA))


@register("src_hourly_energy", rnd(
    "SELECT date_trunc('second', ts) AS Datetime, value AS AEP_MW FROM events", ["AEP_MW"]))
def src_hourly_energy(spark, sf_dir):
    """SRC4: Datetime text parsed to TIMESTAMP_NTZ, load as DOUBLE."""
    ev = table(spark, sf_dir, "events")
    path = scratch_path(spark, "energy-csv")
    SF.write_csv(ev.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Datetime"),
                           F.col("value").alias("AEP_MW")), path)
    return SF.read_hourly_energy(spark, path)


@register("src_fuel_ratings", rnd(with_ctes("SELECT o_orderkey, fuel_type, co2_emissions FROM ratings", RATINGS_CTE),
                                  ["co2_emissions"]))
def src_fuel_ratings(spark, sf_dir):
    """SRC5/PRJ2: first readable candidate path; emission/fuel columns by alias."""
    base = scratch_path(spark, "ratings")
    r = fuel_ratings(spark, sf_dir).select(
        "o_orderkey", F.col("fuel_type").alias("Fuel Type"), F.col("co2_emissions").alias("CO2 Emissions(g/km)"))
    SF.write_csv(r, f"{base}/present")
    df = SF.read_first_available(spark, [f"{base}/absent", f"{base}/present"], SF.read_fuel_ratings)
    return SF.resolve_ratings(df)


def _thr_case(field: int) -> str:
    typed = {k: v for k, v in SF.DEFAULT_CONFIG["efficiency_thresholds"].items() if k != "default"}
    names = ["good", "average", "poor"]
    dflt = SF.DEFAULT_CONFIG["efficiency_thresholds"]["default"][names[field]]
    whens = " ".join(f"WHEN equipment_type = '{k}' THEN {v[names[field]]}e0" for k, v in typed.items())
    return f"CASE {whens} ELSE {dflt}e0 END"


@register("dim_thresholds", rnd(with_t(f"""
SELECT equipment_type, {_thr_case(0)} AS good, {_thr_case(1)} AS average, {_thr_case(2)} AS poor
FROM (SELECT DISTINCT equipment_type FROM t WHERE equipment_type IS NOT NULL)"""), ["good", "average", "poor"]))
def dim_thresholds(spark, sf_dir):
    """SRC6: JSON config (defaults if absent) -> thresholds per telemetry type, ``default`` fallback."""
    path = scratch_path(spark, "config-json")
    spark.createDataFrame([(SF.config_json_text(),)], "value string").coalesce(1).write.text(path)
    cfg = SF.read_config(spark, path)
    thr = SF.efficiency_thresholds(cfg)
    dflt = thr.filter(F.col("equipment_type") == "default")
    types = telemetry(spark, sf_dir).select("equipment_type").filter(F.col("equipment_type").isNotNull()).distinct()
    # The config is one document: its threshold map has a handful of entries.
    j = types.join(F.broadcast(thr.filter(F.col("equipment_type") != "default")), "equipment_type", "left")
    return j.select("equipment_type",
                    *[F.coalesce(F.col(c), dflt.select(F.max(c)).scalar()).alias(c)
                      for c in ("good", "average", "poor")])


ANOMALY_BASE = ["fuel_consumed", "load_pct", "rpm", "speed", "idle_time", "ambient_temp", "engine_temp",
                "oil_pressure", "fuel_efficiency", "emission_rate"]
ANOMALY_OPTIONAL = ["fuel_level_change", "engine_ambient_temp_diff", "consumption_per_load", "battery_voltage",
                    "throttle"]


def impute(df, cols):
    """PRJ14: +-inf -> NaN -> 0, NULL -> 0; absent columns -> 0."""
    out = []
    for c in cols:
        if c in df.columns:
            v = F.col(c).cast("double")
            v = F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(0.0)).otherwise(F.coalesce(v, F.lit(0.0)))
        else:
            v = F.lit(0.0)
        out.append(v.alias(c))
    return out


@register("impute_features", rnd(with_t(f"""
SELECT event_id, {', '.join(f'coalesce(CASE WHEN isnan({c}) OR isinf({c}) THEN 0e0 ELSE {c} END, 0e0) AS {c}'
                             for c in ANOMALY_BASE + ['battery_voltage', 'throttle'])},
  coalesce(fuel_level - lag(fuel_level) OVER (PARTITION BY equipment_id ORDER BY ts, event_id), 0e0) AS fuel_level_change,
  engine_temp - ambient_temp AS engine_ambient_temp_diff,
  CASE WHEN load_pct > 0 THEN fuel_consumed / greatest(1e0, load_pct) ELSE 0e0 END AS consumption_per_load
FROM t"""), ANOMALY_BASE + ANOMALY_OPTIONAL))
def impute_features(spark, sf_dir):
    """PRJ14/FT2 columns: anomaly features made finite and non-null."""
    f = FE.features_all(telemetry(spark, sf_dir), onehot=False)
    return f.select("event_id", *impute(f, ANOMALY_BASE + ANOMALY_OPTIONAL))


@register("export_lookup_json", rnd(with_ctes("""
SELECT 'hourly' AS period, hour AS key, mean_consumption_pct / 1e2 AS value FROM hourly
UNION ALL SELECT 'weekday', key, mean_consumption_pct / 1e2 FROM cal WHERE period = 'weekday'
UNION ALL SELECT 'monthly', key, mean_consumption_pct / 1e2 FROM cal WHERE period = 'month'""",
    PCT_CTE, HOURLY_CTE, CAL_CTE), ["value"]))
def export_lookup_json(spark, sf_dir):
    """SNK2: activity-factor lookups written as JSON maps (integer keys) and read back."""
    pct = P.daily_pct_of_max(table(spark, sf_dir, "events"))
    h = P.hourly_profile(pct).select(F.lit("hourly").alias("period"), F.col("hour").alias("key"),
                                     (F.col("mean_consumption_pct") / 100.0).alias("value"))
    cal = P.calendar_profile(pct).filter(F.col("period") != "weekend").select(
        F.when(F.col("period") == "month", "monthly").otherwise(F.col("period")).alias("period"),
        "key", (F.col("mean_consumption_pct") / 100.0).alias("value"))
    path = scratch_path(spark, "lookup-json")
    SF.write_lookup_json(h.unionByName(cal), "period", "key", "value", path)
    return SF.read_lookup_json(spark, path, "period")
