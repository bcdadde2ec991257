"""Registered jobs: reference patterns and equipment profile (build steps 5-6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tankwise.functions import scalar as S
from tankwise.operators import anomaly as A
from tankwise.operators import patterns as P
from tankwise.operators import profile as PR
from tankwise.plans.registry import (ECONOMY_CTE, RATINGS_CTE, register, rnd, with_ctes, with_t)
from tankwise.sources.tables import economy, fuel_ratings, table, telemetry

BIN_EDGES = [10, 20, 30, 40, 50, 60, 70, 80]
WEIGHT_SCALE = 50.0  # fixture: kg weight classes -> l_quantity units


def _kw_case(col: str, pairs, default: str) -> str:
    s = f"lower(coalesce(CAST({col} AS VARCHAR), 'None'))"
    whens = " ".join(f"WHEN contains({s}, '{k.lower()}') THEN '{v}'" for k, v in pairs)
    return f"CASE {whens} ELSE '{default}' END"


def _map_case(col: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} ELSE '{default}' END"


FUEL_GROUP_SQL = """CASE
  WHEN contains(lower(coalesce(fuel_type, 'none')), 'natural') OR contains(lower(coalesce(fuel_type, 'none')), 'cng')
       OR lower(coalesce(fuel_type, 'none')) = 'n' THEN 'Natural Gas'
  WHEN contains(lower(coalesce(fuel_type, 'none')), 'gasoline') OR contains(lower(coalesce(fuel_type, 'none')), 'gas')
       OR lower(coalesce(fuel_type, 'none')) = 'x' THEN 'Gasoline'
  WHEN contains(lower(coalesce(fuel_type, 'none')), 'diesel') OR lower(coalesce(fuel_type, 'none')) = 'd' THEN 'Diesel'
  WHEN contains(lower(coalesce(fuel_type, 'none')), 'electric') OR contains(lower(coalesce(fuel_type, 'none')), 'battery')
       OR lower(coalesce(fuel_type, 'none')) = 'e' THEN 'Electric'
  ELSE 'Other' END"""

CLASS_CASE = _kw_case("VClass", S.VEHICLE_CLASS_KEYWORDS, S.DEFAULT_CLASS_EQUIPMENT)
UNIT_FLAG_CTE = "flag AS (SELECT median(comb08) > 15 AS is_mpg FROM econ)"
CONVERTED_CTE = f"""conv AS (
  SELECT p_partkey, {CLASS_CASE} AS equipment_type,
    CASE WHEN is_mpg THEN city08 * 4.25e-1 ELSE 1e2 / city08 END AS city_efficiency_km_per_l,
    CASE WHEN is_mpg THEN 1e2 / (city08 * 4.25e-1) ELSE city08 END AS city_consumption_l_per_100km,
    CASE WHEN is_mpg THEN highway08 * 4.25e-1 ELSE 1e2 / highway08 END AS highway_efficiency_km_per_l,
    CASE WHEN is_mpg THEN 1e2 / (highway08 * 4.25e-1) ELSE highway08 END AS highway_consumption_l_per_100km,
    CASE WHEN is_mpg THEN comb08 * 4.25e-1 ELSE 1e2 / comb08 END AS combined_efficiency_km_per_l,
    CASE WHEN is_mpg THEN 1e2 / (comb08 * 4.25e-1) ELSE comb08 END AS combined_consumption_l_per_100km
  FROM econ, flag)"""
MEASURES = P.EFFICIENCY_MEASURES
EFF_CTE = ("eff AS (SELECT equipment_type, " + ", ".join(f"avg({m}) AS {m}" for m in MEASURES)
           + " FROM conv GROUP BY equipment_type)")


@register("unit_detection", with_ctes("""
SELECT CAST(count(comb08) AS BIGINT) AS n, CAST(count_if(comb08 > 15) AS BIGINT) AS n_above,
       median(comb08) AS median_value, median(comb08) > 15 AS is_mpg FROM econ""", ECONOMY_CTE))
def unit_detection(spark, sf_dir):
    """AG11: exact median test MPG vs L/100 km (count-based decision; the median by rank search)."""
    return P.unit_detection(economy(spark, sf_dir), "comb08")


@register("unit_conversion", rnd(with_ctes(
    "SELECT p_partkey, " + ", ".join(MEASURES) + " FROM conv",
    ECONOMY_CTE, UNIT_FLAG_CTE, CONVERTED_CTE), MEASURES))
def unit_conversion(spark, sf_dir):
    """SC1/SC2: km/L and L/100 km for city, highway, combined."""
    e = economy(spark, sf_dir)
    is_mpg = P.unit_flag(e, "comb08").select("is_mpg").scalar()
    return P.unit_conversion(e, "city08", "highway08", "comb08", is_mpg).select("p_partkey", *MEASURES)


@register("class_mapping", with_ctes(f"""
SELECT p_partkey, VClass, {CLASS_CASE} AS equipment_type,
  {_kw_case('model', S.EQUIPMENT_KEYWORDS, 'Other')} AS normalized_name FROM econ""", ECONOMY_CTE))
def class_mapping(spark, sf_dir):
    """JN5/SC17: vehicle class -> equipment type; name normaliser."""
    e = economy(spark, sf_dir)
    return e.select("p_partkey", "VClass", S.class_to_equipment(F.col("VClass")).alias("equipment_type"),
                    S.normalize_equipment_name(F.col("model")).alias("normalized_name"))


@register("pattern_equipment_efficiency", rnd(with_ctes(
    "SELECT * FROM eff", ECONOMY_CTE, UNIT_FLAG_CTE, CONVERTED_CTE, EFF_CTE), MEASURES))
def pattern_equipment_efficiency(spark, sf_dir):
    """AG1 (+PRJ1-3): mean efficiency/consumption per equipment type."""
    return P.equipment_efficiency(economy(spark, sf_dir))


@register("pattern_cylinder_efficiency", rnd("""
SELECT l_linenumber, avg(l_quantity) AS mpg_mean, stddev_samp(l_quantity) AS mpg_std,
  avg(l_quantity * 4.25e-1) AS fuel_efficiency_km_per_l_mean,
  stddev_samp(l_quantity * 4.25e-1) AS fuel_efficiency_km_per_l_std
FROM lineitem WHERE l_linenumber IS NOT NULL GROUP BY l_linenumber""",
    ["mpg_mean", "mpg_std", "fuel_efficiency_km_per_l_mean", "fuel_efficiency_km_per_l_std"]))
def pattern_cylinder_efficiency(spark, sf_dir):
    """AG2: mean and sample std by a small integer key."""
    return P.cylinder_efficiency(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_quantity")


LINE_CTE = """line AS (SELECT regr_slope(l_extendedprice / 1e3, l_quantity) AS slope,
  regr_intercept(l_extendedprice / 1e3, l_quantity) AS intercept,
  CAST(regr_count(l_extendedprice / 1e3, l_quantity) AS BIGINT) AS n FROM lineitem)"""
BINS_VALUES = ", ".join(f"({float(BIN_EDGES[i])}e0, {float(BIN_EDGES[i + 1])}e0, '{BIN_EDGES[i]}-{BIN_EDGES[i + 1]}')"
                        for i in range(len(BIN_EDGES) - 1))
BIN_CTE = f"""bins AS (SELECT * FROM (VALUES {BINS_VALUES}) b(lo, hi, bin)),
binned AS (SELECT 1e1 + floor((l_quantity - 1e1) / 1e1) * 1e1 AS lo, avg(l_extendedprice / 1e3) AS avg_y,
                  count(*) AS n
           FROM lineitem WHERE l_quantity >= 1e1 AND l_quantity < 8e1 GROUP BY 1),
binval AS (SELECT b.lo, b.hi, b.bin, CAST(coalesce(binned.n, 0) AS BIGINT) AS n, avg_y,
       coalesce(avg_y, intercept + slope * (b.lo + b.hi) / 2) AS value
FROM bins b LEFT JOIN binned ON b.lo = binned.lo CROSS JOIN line)"""


def _lineitem_xy(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_quantity", (F.col("l_extendedprice") / 1e3).alias("y"))


@register("regression_line", rnd(with_ctes("SELECT * FROM line", LINE_CTE), ["slope", "intercept"]))
def regression_line(spark, sf_dir):
    """AG10: OLS slope and intercept in one aggregate."""
    return P.regression_line(_lineitem_xy(spark, sf_dir), "l_quantity", "y")


@register("bin_consumption", rnd(with_ctes("SELECT * FROM binval", LINE_CTE, BIN_CTE),
                                 ["lo", "hi", "avg_y", "value"]))
def bin_consumption(spark, sf_dir):
    """AG9/PRJ8: half-open bin means, empty bins from the OLS line."""
    return P.bin_average(_lineitem_xy(spark, sf_dir), "l_quantity", "y", BIN_EDGES)


def _class_range_sql(scale: float) -> str:
    heavy = ", ".join(f"'{t}'" for t in P.HEAVY_TYPES)
    medium = ", ".join(f"'{t}'" for t in P.MEDIUM_TYPES)
    h, m, lt = P.WEIGHT_CLASS["heavy"], P.WEIGHT_CLASS["medium"], P.WEIGHT_CLASS["light"]
    lo = (f"CAST(CASE WHEN equipment_type IN ({heavy}) THEN {h[0]} WHEN equipment_type IN ({medium}) "
          f"THEN {m[0]} ELSE {lt[0]} END AS DOUBLE) / {scale}e0")
    hi = (f"CAST(CASE WHEN equipment_type IN ({heavy}) THEN {h[1]} WHEN equipment_type IN ({medium}) "
          f"THEN {m[1]} ELSE {lt[1]} END AS DOUBLE) / {scale}e0")
    return f"""classes AS (SELECT equipment_type, {lo} AS class_lo, {hi} AS class_hi
  FROM (SELECT DISTINCT equipment_type FROM t WHERE equipment_type IS NOT NULL)),
lookup AS (SELECT c.equipment_type, c.class_lo, c.class_hi, (c.class_lo + c.class_hi) / 2 AS class_mid,
  coalesce(v.value, {P.DEFAULT_BIN_CONSUMPTION}e0) AS consumption
  FROM classes c LEFT JOIN binval v ON (c.class_lo + c.class_hi) / 2 >= v.lo AND (c.class_lo + c.class_hi) / 2 < v.hi)"""


def range_lookup_df(spark, sf_dir):
    types = P_types(spark, sf_dir)
    bins = P.bin_average(_lineitem_xy(spark, sf_dir), "l_quantity", "y", BIN_EDGES)
    return P.range_lookup(types, bins, WEIGHT_SCALE)


def P_types(spark, sf_dir):
    return telemetry(spark, sf_dir).select("equipment_type").filter(
        F.col("equipment_type").isNotNull()).distinct()


@register("range_lookup", rnd(with_t("SELECT * FROM lookup", LINE_CTE, BIN_CTE, _class_range_sql(WEIGHT_SCALE)),
                              ["class_lo", "class_hi", "class_mid", "consumption"]))
def range_lookup(spark, sf_dir):
    """JN4: weight class midpoint -> bin (range join), default 20."""
    return range_lookup_df(spark, sf_dir)


PCT_CTE = """pct AS (
  SELECT e.event_id, CAST(e.ts AS DATE) AS date, CAST(hour(e.ts) AS INTEGER) AS hour,
    CAST(isodow(e.ts) - 1 AS INTEGER) AS weekday, CAST(month(e.ts) AS INTEGER) AS month,
    CAST(isodow(e.ts) - 1 >= 5 AS INTEGER) AS is_weekend, d.daily_max, e.value / d.daily_max * 1e2 AS consumption_pct
  FROM events e JOIN (SELECT CAST(ts AS DATE) AS date, max(value) AS daily_max FROM events GROUP BY 1) d
    ON CAST(e.ts AS DATE) = d.date)"""
HOURLY_CTE = """hourly AS (SELECT hour, avg(consumption_pct) AS mean_consumption_pct,
  stddev_samp(consumption_pct) AS std_consumption_pct FROM pct GROUP BY hour)"""
CAL_CTE = """cal AS (
  SELECT 'weekday' AS period, weekday AS key, avg(consumption_pct) AS mean_consumption_pct,
         stddev_samp(consumption_pct) AS std_consumption_pct FROM pct GROUP BY weekday
  UNION ALL
  SELECT 'month', month, avg(consumption_pct), stddev_samp(consumption_pct) FROM pct GROUP BY month
  UNION ALL
  SELECT 'weekend', is_weekend, avg(consumption_pct), stddev_samp(consumption_pct) FROM pct GROUP BY is_weekend)"""


def _pct(spark, sf_dir):
    return P.daily_pct_of_max(table(spark, sf_dir, "events"))


@register("daily_pct_of_max", rnd(with_ctes(
    "SELECT event_id, date, hour, weekday, month, is_weekend, daily_max, consumption_pct FROM pct", PCT_CTE),
    ["daily_max", "consumption_pct"]))
def daily_pct_of_max(spark, sf_dir):
    """JN1/AG3: each reading as percent of its day's maximum."""
    return _pct(spark, sf_dir).select("event_id", "date", "hour", "weekday", "month", "is_weekend",
                                      "daily_max", "consumption_pct")


@register("pattern_hourly", rnd(with_ctes("SELECT * FROM hourly", PCT_CTE, HOURLY_CTE),
                                ["mean_consumption_pct", "std_consumption_pct"]))
def pattern_hourly(spark, sf_dir):
    """AG4: hourly profile of percent-of-daily-max."""
    return P.hourly_profile(_pct(spark, sf_dir))


@register("pattern_calendar", rnd(with_ctes("SELECT * FROM cal", PCT_CTE, CAL_CTE),
                                  ["mean_consumption_pct", "std_consumption_pct"]))
def pattern_calendar(spark, sf_dir):
    """AG5: weekday / month / weekend profiles in one grouping-sets pass."""
    return P.calendar_profile(_pct(spark, sf_dir))


@register("activity_factor", rnd(with_t("""
SELECT t.event_id, coalesce(h.mean_consumption_pct / 1e2, 5e-1) AS hour_factor,
  coalesce(w.mean_consumption_pct / 1e2, 5e-1) AS weekday_factor,
  coalesce(m.mean_consumption_pct / 1e2, 5e-1) AS month_factor,
  coalesce(h.mean_consumption_pct / 1e2, 5e-1) * coalesce(w.mean_consumption_pct / 1e2, 5e-1)
    * coalesce(m.mean_consumption_pct / 1e2, 5e-1) AS activity_factor
FROM t
LEFT JOIN hourly h ON h.hour = CAST(hour(t.ts) AS INTEGER)
LEFT JOIN (SELECT * FROM cal WHERE period = 'weekday') w ON w.key = CAST(isodow(t.ts) - 1 AS INTEGER)
LEFT JOIN (SELECT * FROM cal WHERE period = 'month') m ON m.key = CAST(month(t.ts) AS INTEGER)""",
    PCT_CTE, HOURLY_CTE, CAL_CTE), ["hour_factor", "weekday_factor", "month_factor", "activity_factor"]))
def activity_factor(spark, sf_dir):
    """SC27: hour x weekday x month activity factor (integer keys, default 0.5)."""
    pct = _pct(spark, sf_dir)
    t = telemetry(spark, sf_dir).select("event_id", "ts")
    out = P.activity_factor(t, P.hourly_profile(pct), P.calendar_profile(pct))
    return out.select("event_id", "hour_factor", "weekday_factor", "month_factor", "activity_factor")


BYFUEL_CTE = f"""byfuel AS (SELECT fuel_type, avg(co2_emissions) AS mean_emissions,
  stddev_samp(co2_emissions) AS std_emissions, {FUEL_GROUP_SQL} AS engine_type
  FROM ratings WHERE fuel_type IS NOT NULL GROUP BY fuel_type)"""
BYENGINE_CTE = """byengine AS (SELECT engine_type, avg(mean_emissions) AS mean_emissions,
  avg(std_emissions) AS std_emissions FROM byfuel GROUP BY engine_type)"""


@register("pattern_emissions_fuel", rnd(with_ctes("SELECT * FROM byfuel", RATINGS_CTE, BYFUEL_CTE),
                                        ["mean_emissions", "std_emissions"]))
def pattern_emissions_fuel(spark, sf_dir):
    """AG6/SC18: emissions by fuel label with normalised engine group."""
    return P.emissions_by_fuel(fuel_ratings(spark, sf_dir), "fuel_type", "co2_emissions")


@register("pattern_emissions_engine", rnd(with_ctes("SELECT * FROM byengine", RATINGS_CTE, BYFUEL_CTE,
                                                    BYENGINE_CTE), ["mean_emissions", "std_emissions"]))
def pattern_emissions_engine(spark, sf_dir):
    """AG7: unweighted two-stage mean by engine type."""
    return P.emissions_by_engine(P.emissions_by_fuel(fuel_ratings(spark, sf_dir), "fuel_type", "co2_emissions"))


PATTERN_UNPIVOT = ", ".join(f"{c} AS {s}" for c, s, _ in P.PROFILE_METRICS)
PATTERNS_CTE = f"""patterns AS (
  SELECT equipment_type, metric, avg(value) AS mean, greatest(1e-1, stddev_samp(value)) AS std,
         min(value) AS min, max(value) AS max
  FROM (UNPIVOT (SELECT equipment_type, {PATTERN_UNPIVOT} FROM t WHERE equipment_type IS NOT NULL)
        ON {', '.join(s for _, s, _ in P.PROFILE_METRICS)} INTO NAME metric VALUE value)
  GROUP BY equipment_type, metric)"""


@register("equipment_patterns", rnd(with_t("SELECT * FROM patterns", PATTERNS_CTE), ["mean", "std", "min", "max"]))
def equipment_patterns(spark, sf_dir):
    """AG8: per type x metric mean, max(0.1, std), min, max (defaults if absent)."""
    return P.equipment_patterns(telemetry(spark, sf_dir))


PROFILE_SQL = f"""
SELECT ty.equipment_type,
  {_map_case('ty.equipment_type', S.VEHICLE_CLASS_BY_EQUIPMENT, S.DEFAULT_VEHICLE_CLASS)} AS vehicle_class,
  {_map_case('ty.equipment_type', S.ENGINE_BY_EQUIPMENT, S.DEFAULT_ENGINE)} AS engine_type,
  coalesce(eff.combined_efficiency_km_per_l, 5e0) AS efficiency_combined,
  coalesce(eff.city_efficiency_km_per_l, 4e0) AS efficiency_city,
  coalesce(eff.highway_efficiency_km_per_l, 6e0) AS efficiency_highway,
  lookup.consumption AS consumption_per_100km,
  coalesce(byengine.mean_emissions, 2e2) AS base_emissions,
  coalesce(byengine.std_emissions, 2e1) AS emissions_std
FROM (SELECT DISTINCT equipment_type FROM t WHERE equipment_type IS NOT NULL) ty
LEFT JOIN eff ON eff.equipment_type = ty.equipment_type
LEFT JOIN byengine ON byengine.engine_type =
  {_map_case('ty.equipment_type', S.ENGINE_BY_EQUIPMENT, S.DEFAULT_ENGINE)}
LEFT JOIN lookup ON lookup.equipment_type = ty.equipment_type"""


@register("equipment_profile", rnd(with_t(
    PROFILE_SQL, ECONOMY_CTE, UNIT_FLAG_CTE, CONVERTED_CTE, EFF_CTE, RATINGS_CTE, BYFUEL_CTE, BYENGINE_CTE,
    LINE_CTE, BIN_CTE, _class_range_sql(WEIGHT_SCALE)),
    ["efficiency_combined", "efficiency_city", "efficiency_highway", "consumption_per_100km",
     "base_emissions", "emissions_std"]))
def equipment_profile(spark, sf_dir):
    """JN2/JN3/SC16: per-type efficiency, engine, emissions and consumption with defaults."""
    eff = P.equipment_efficiency(economy(spark, sf_dir))
    eng = P.emissions_by_engine(P.emissions_by_fuel(fuel_ratings(spark, sf_dir), "fuel_type", "co2_emissions"))
    return PR.equipment_profile(P_types(spark, sf_dir), eff, eng, range_lookup_df(spark, sf_dir))


@register("status_labels", with_t("""
SELECT event_id,
  CASE WHEN hours_since_service > 500 THEN 'Needs Service' WHEN hours_since_service > 400 THEN 'Service Due Soon'
       ELSE 'Normal' END AS maintenance_label,
  CASE WHEN operational_status = 'Running' AND NOT coalesce(idle_time > 0, false) THEN
       CASE WHEN speed < 10 THEN '1' WHEN speed < 20 THEN '2' WHEN speed < 30 THEN '3' WHEN speed < 40 THEN '4'
            ELSE '5' END ELSE 'N' END AS gear_label,
  CASE WHEN refuel_event = 'Yes' THEN 'Refueling event'
       WHEN sensor_fault > 0 THEN concat('Sensor fault detected: ', CAST(sensor_fault AS VARCHAR))
       WHEN hours_since_service > 500 THEN 'Maintenance needed'
       WHEN fuel_level < tank_capacity * 1e-1 THEN 'Low fuel warning' END AS note_label
FROM t"""))
def status_labels(spark, sf_dir):
    """SC13-SC15: maintenance label, gear from speed, event-note precedence."""
    t = telemetry(spark, sf_dir)
    return PR.status_labels(t).select("event_id", "maintenance_label", "gear_label", "note_label")


EXPECTED_CTE = """expected AS (
  SELECT t.*, b.base_consumption, b.base_emission,
    CASE WHEN idle_time > 0 THEN b.base_consumption * 3e-1
         ELSE b.base_consumption * (5e-1 + 5e-1 * load_pct / 1e2)
              * CASE WHEN speed > 0 THEN 7e-1 + 3e-1 * speed / 3e1 ELSE 7e-1 END END
      * CASE WHEN month(ts) <= 3 OR month(ts) >= 11 THEN 9e-1
             WHEN (month(ts) >= 4 AND month(ts) <= 5) OR (month(ts) >= 9 AND month(ts) <= 10) THEN 1e0
             ELSE 9.5e-1 END AS expected_consumption,
    b.base_emission * (7e-1 + 3e-1 * load_pct / 1e2)
      * CASE WHEN month(ts) <= 3 OR month(ts) >= 11 THEN 9e-1
             WHEN (month(ts) >= 4 AND month(ts) <= 5) OR (month(ts) >= 9 AND month(ts) <= 10) THEN 1e0
             ELSE 9.5e-1 END AS expected_emission
  FROM t LEFT JOIN (
    SELECT equipment_type, max(CASE WHEN metric = 'fuel_consumed' THEN mean END) AS base_consumption,
           max(CASE WHEN metric = 'emission_rate' THEN mean END) AS base_emission
    FROM patterns GROUP BY equipment_type) b USING (equipment_type))"""


@register("expected_consumption", rnd(with_t(
    "SELECT event_id, base_consumption, expected_consumption, base_emission, expected_emission FROM expected",
    PATTERNS_CTE, EXPECTED_CTE), ["base_consumption", "expected_consumption", "base_emission", "expected_emission"]))
def expected_consumption(spark, sf_dir):
    """SC21/SC22: expected consumption and emission from per-type profile means."""
    t = telemetry(spark, sf_dir)
    out = A.expected_columns(t, P.equipment_patterns(t))
    return out.select("event_id", F.col("base_consumption"), "expected_consumption",
                      F.col("base_emission"), "expected_emission")
