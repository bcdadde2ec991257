"""Registered jobs: feature engineering (build step 4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tankwise.functions import scalar as S
from tankwise.operators import features as FE
from tankwise.operators.sequence import ordered_split as split_op
from tankwise.plans.registry import TELEMETRY_DOUBLES, register, rnd, with_t
from tankwise.sources.tables import telemetry

W = "WINDOW w AS (PARTITION BY equipment_id ORDER BY ts, event_id)"

CAL_SQL = {
    "hour": "CAST(hour(ts) AS INTEGER)", "day": "CAST(day(ts) AS INTEGER)",
    "month": "CAST(month(ts) AS INTEGER)", "weekday": "CAST(isodow(ts) - 1 AS INTEGER)",
    "date": "CAST(ts AS DATE)", "is_weekend": "CAST(isodow(ts) - 1 >= 5 AS INTEGER)",
    "is_work_hours": "CAST(hour(ts) >= 9 AND hour(ts) < 17 AS INTEGER)",
}
FLAG_SQL = {
    "fuel_level_pct": "fuel_level / tank_capacity * 1e2",
    "is_low_fuel": "CAST(fuel_level / tank_capacity * 1e2 < 20 AS INTEGER)",
    "is_idle": "CAST(idle_time > 0 AS INTEGER)",
    "is_active": "CAST(operational_status = 'Running' AS INTEGER)",
    "consumption_per_load": "CASE WHEN load_pct > 0 THEN fuel_consumed / greatest(1e0, load_pct) ELSE 0e0 END",
    "engine_ambient_temp_diff": "engine_temp - ambient_temp",
    "maintenance_due_soon": "CAST(hours_since_service > 400 AS INTEGER)",
    "has_sensor_fault": "CAST(sensor_fault > 0 AS INTEGER)",
    "engine_overheating": "CAST(engine_temp > 100 AS INTEGER)",
    "oil_pressure_warning": "CAST(oil_pressure < 20 AS INTEGER)",
}
FLAG_DOUBLES = ["fuel_level_pct", "consumption_per_load", "engine_ambient_temp_diff"]
LAG_SQL = {
    "prev_fuel_level": "coalesce(lag(fuel_level) OVER w, fuel_level)",
    "prev_load": "coalesce(lag(load_pct) OVER w, load_pct)",
    "prev_rpm": "coalesce(lag(rpm) OVER w, rpm)",
    "fuel_level_change": "coalesce(fuel_level - lag(fuel_level) OVER w, 0e0)",
}
# Frame sums are reduced left to right over the ordered frame (as Spark's
# sliding frame does), so both engines produce bit-identical means.
def _frame_mean(src: str, n: int) -> str:
    lst = (f"list_filter(list({src} ORDER BY ts, event_id) OVER (PARTITION BY equipment_id "
           f"ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), lambda v: v IS NOT NULL)")
    return f"list_reduce({lst}, lambda a, b: a + b) / len({lst})"


ROLL_SQL = {
    f"avg_{short}_{n}h": (f"coalesce(CASE WHEN count(*) OVER (PARTITION BY equipment_id) >= {n} THEN "
                          f"{_frame_mean(src, n)} END, {src})")
    for n in FE.ROLL_FRAMES for short, src in FE.ROLL_MEASURES.items()
}
ONEHOT_SQL = {FE.onehot_name(c, v): f"CAST({c} = '{v}' AS INTEGER)"
              for c, vals in FE.ONEHOT_LEVELS.items() for v in vals}
ONEHOT_SQL.update({FE.onehot_name(c, FE.OTHER): f"CAST({c} NOT IN ({', '.join(repr(v) for v in vals)}) AS INTEGER)"
                   for c, vals in FE.ONEHOT_LEVELS.items()})


def _sel(d: dict) -> str:
    return ",\n  ".join(f"{expr} AS {name}" for name, expr in d.items())


@register("features_calendar", with_t(f"""
SELECT event_id, equipment_id, ts,
  {_sel(CAL_SQL)}
FROM t"""))
def features_calendar(spark, sf_dir):
    """SC3/SC4: hour, day, month, weekday (Mon=0), date, weekend, work hours."""
    t = telemetry(spark, sf_dir).select("event_id", "equipment_id", "ts")
    return FE.with_calendar(t)


@register("features_flags", rnd(with_t(f"""
SELECT event_id,
  {_sel(FLAG_SQL)}
FROM t"""), FLAG_DOUBLES))
def features_flags(spark, sf_dir):
    """SC5-SC9: level %, low fuel, idle, active, consumption per load, temp diff, warnings."""
    t = telemetry(spark, sf_dir)
    return FE.with_flags(t).select("event_id", *FLAG_SQL)


@register("features_lag", rnd(with_t(f"""
SELECT event_id, equipment_id, ts,
  {_sel(LAG_SQL)}
FROM t {W}"""), list(LAG_SQL)))
def features_lag(spark, sf_dir):
    """WN3/WN4 + SC10: previous level/load/RPM and level change per unit."""
    t = telemetry(spark, sf_dir).select("event_id", "equipment_id", "ts", "fuel_level", "load_pct", "rpm")
    return FE.with_lags(t).select("event_id", "equipment_id", "ts", *LAG_SQL)


# Rows without a unit or a time: an ordinary outcome of cleaning at ingestion.
NULL_KEYS_CTE = """u AS (SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS ts,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE equipment_id END AS equipment_id) FROM t)"""


@register("features_null_keys", rnd(with_t(f"""
SELECT event_id, equipment_id, ts,
  {_sel(LAG_SQL)},
  {_sel(ROLL_SQL).replace('ORDER BY ts', 'ORDER BY ts NULLS FIRST')}
FROM u {W.replace('ORDER BY ts', 'ORDER BY ts NULLS FIRST')}""", NULL_KEYS_CTE), list(LAG_SQL) + list(ROLL_SQL)))
def features_null_keys(spark, sf_dir):
    """WN3-WN6 over telemetry with some units and times missing: every row is kept."""
    t = telemetry(spark, sf_dir).select("event_id", "equipment_id", "ts", "fuel_level", "load_pct", "rpm",
                                        "fuel_consumed", "speed")
    t = t.withColumns({"ts": F.when(F.col("event_id") % 7 != 0, F.col("ts")),
                       "equipment_id": F.when(F.col("event_id") % 11 != 0, F.col("equipment_id"))})
    return FE.with_windows(t).select("event_id", "equipment_id", "ts", *LAG_SQL, *ROLL_SQL)


@register("features_rolling", rnd(with_t(f"""
SELECT event_id, equipment_id, ts,
  {_sel(ROLL_SQL)}
FROM t"""), list(ROLL_SQL)))
def features_rolling(spark, sf_dir):
    """WN5/WN6: 6/12/24-row trailing means, gated by unit size."""
    t = telemetry(spark, sf_dir).select("event_id", "equipment_id", "ts", "fuel_consumed", "load_pct", "speed")
    return FE.with_rolling(t).select("event_id", "equipment_id", "ts", *ROLL_SQL)


@register("onehot", with_t(f"""
SELECT event_id,
  {_sel(ONEHOT_SQL)}
FROM t"""))
def onehot(spark, sf_dir):
    """SC11: one-hot columns for five categoricals, all levels kept."""
    t = telemetry(spark, sf_dir)
    return FE.with_onehot(t).select("event_id", *ONEHOT_SQL)


# Levels that the listed vocabulary lacks.
UNSEEN_CTE = """s AS (SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN 'Grader' ELSE equipment_type END AS equipment_type,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE gear END AS gear) FROM t)"""


@register("onehot_unseen", with_t(f"""
SELECT event_id,
  {_sel(ONEHOT_SQL)}
FROM s""", UNSEEN_CTE))
def onehot_unseen(spark, sf_dir):
    """SC11 over rows with unlisted and missing levels."""
    t = telemetry(spark, sf_dir).withColumns({
        "equipment_type": F.when(F.col("event_id") % 5 == 0, F.lit("Grader")).otherwise(F.col("equipment_type")),
        "gear": F.when(F.col("event_id") % 9 != 0, F.col("gear"))})
    return FE.with_onehot(t).select("event_id", *ONEHOT_SQL)


@register("features_all", rnd(with_t(f"""
SELECT *,
  {_sel(CAL_SQL)},
  {_sel(FLAG_SQL)},
  {_sel(LAG_SQL)},
  {_sel(ROLL_SQL)},
  {_sel(ONEHOT_SQL)}
FROM t {W}"""), TELEMETRY_DOUBLES + FLAG_DOUBLES + list(LAG_SQL) + list(ROLL_SQL)))
def features_all(spark, sf_dir):
    """FT1: the full feature table in one shuffle."""
    return FE.features_all(telemetry(spark, sf_dir))


@register("avg_load_3h", rnd(with_t("""
SELECT event_id, equipment_id, ts,
  avg(load_pct) OVER (PARTITION BY equipment_id ORDER BY ts
                      RANGE BETWEEN INTERVAL 3 HOUR PRECEDING AND CURRENT ROW) AS avg_load_3h
FROM t"""), ["avg_load_3h"]))
def avg_load_3h(spark, sf_dir):
    """WN8: mean load over the trailing three hours (time range)."""
    t = telemetry(spark, sf_dir).select("event_id", "equipment_id", "ts", "load_pct")
    return FE.with_avg_load_3h(t).select("event_id", "equipment_id", "ts", "avg_load_3h")


@register("derived_efficiency", rnd(with_t("""
SELECT event_id, speed * (1e0 - idle_time / 6e1) AS distance_calc,
  CASE WHEN fuel_consumed > 0 AND speed * (1e0 - idle_time / 6e1) > 0
       THEN speed * (1e0 - idle_time / 6e1) / fuel_consumed ELSE 0e0 END AS efficiency_calc
FROM t"""), ["distance_calc", "efficiency_calc"]))
def derived_efficiency(spark, sf_dir):
    """SC19: distance from speed and idle minutes; guarded km/L."""
    t = telemetry(spark, sf_dir).select("event_id", "speed", "idle_time", "fuel_consumed")
    return FE.derived_efficiency(t).select("event_id", "distance_calc", "efficiency_calc")


@register("ordered_split", with_t("""
SELECT event_id, equipment_id, ts,
  row_number() OVER (ORDER BY equipment_id, ts, event_id) <= floor(count(*) OVER () * 8e-1) AS is_train
FROM t"""))
def ordered_split(spark, sf_dir):
    """WN10: first floor(0.8 N) rows in (unit, time) order are training rows."""
    t = telemetry(spark, sf_dir).select("event_id", "equipment_id", "ts")
    return split_op(t, 0.8)


@register("consumption_trend", rnd(with_t("""
SELECT equipment_id,
  first(fuel_consumed ORDER BY ts, event_id) AS first_consumption,
  last(fuel_consumed ORDER BY ts, event_id) AS last_consumption,
  CAST(count(*) AS BIGINT) AS n,
  CASE WHEN count(*) < 2 THEN 'stable'
       WHEN abs(last(fuel_consumed ORDER BY ts, event_id) - first(fuel_consumed ORDER BY ts, event_id))
            < 5e-2 * abs(first(fuel_consumed ORDER BY ts, event_id)) THEN 'stable'
       WHEN last(fuel_consumed ORDER BY ts, event_id) > first(fuel_consumed ORDER BY ts, event_id) THEN 'increasing'
       ELSE 'decreasing' END AS trend
FROM t WHERE fuel_consumed IS NOT NULL GROUP BY equipment_id"""), ["first_consumption", "last_consumption"]))
def consumption_trend(spark, sf_dir):
    """WN9: trend of each unit's consumption series (first vs last)."""
    t = telemetry(spark, sf_dir).filter(F.col("fuel_consumed").isNotNull())
    o = F.struct("ts", "event_id")
    g = t.groupBy("equipment_id").agg(F.min_by("fuel_consumed", o).alias("first_consumption"),
                                      F.max_by("fuel_consumed", o).alias("last_consumption"),
                                      F.count(F.lit(1)).cast("long").alias("n"))
    return g.withColumn("trend", S.trend_direction("first_consumption", "last_consumption", "n"))
