"""Registered jobs: equipment state and insights (build step 8).

The forecast input of the jobs with SQL is the trailing-day mean consumption per unit
(the forecast frame's shape); the ``*_from_models`` jobs feed the trained models'
forecasts into the same operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tankwise.operators import anomaly as A
from tankwise.operators import insights as I
from tankwise.operators import patterns as P
from tankwise.operators.joins import materialize_small
from tankwise.plans.q_anomaly import ROLLUP_CTE, RULE_CTES
from tankwise.plans.q_views import LATEST_SQL
from tankwise.plans.registry import register, rnd, with_t
from tankwise.sources.tables import telemetry

STATE_CTE = f"""latest AS ({LATEST_SQL}),
counters AS (
  SELECT equipment_id,
    CAST(count_if(operational_status = 'Running' AND idle_time > 0) AS BIGINT) AS total_idle_time,
    CAST(count_if(operational_status = 'Running' AND NOT coalesce(idle_time > 0, false)) AS BIGINT) AS total_active_time,
    CAST(count_if(fuel_consumed > 0) AS BIGINT) AS n_consumption,
    avg(CASE WHEN fuel_consumed > 0 THEN fuel_consumed END) AS avg_consumption,
    CAST(count_if(fuel_efficiency > 0) AS BIGINT) AS n_efficiency,
    avg(CASE WHEN fuel_efficiency > 0 THEN fuel_efficiency END) AS avg_efficiency,
    max(CASE WHEN refuel_event = 'Yes' THEN ts END) AS last_refuel
  FROM t GROUP BY equipment_id),
fc AS (SELECT equipment_id, avg(fuel_consumed) AS predicted_consumption FROM t
       WHERE ts >= (SELECT max(ts) FROM t) - INTERVAL 24 HOUR GROUP BY equipment_id),
state AS (
  SELECT l.equipment_id, l.ts, l.event_id, l.equipment_type, l.fuel_level, l.tank_capacity, l.operational_status,
    l.maintenance_status, l.hours_since_service, c.total_idle_time, c.total_active_time, c.n_consumption,
    c.avg_consumption, c.n_efficiency, c.avg_efficiency, c.last_refuel,
    l.fuel_level / l.tank_capacity * 1e2 AS fuel_level_percentage, l.ts AS last_update,
    fc.predicted_consumption,
    CASE WHEN fc.predicted_consumption > 0 THEN l.fuel_level / fc.predicted_consumption END AS estimated_runtime,
    (SELECT max(ts) FROM t) AS as_of
  FROM latest l JOIN counters c USING (equipment_id) LEFT JOIN fc USING (equipment_id))"""
STATE_DOUBLES = ["fuel_level", "tank_capacity", "hours_since_service", "avg_consumption", "avg_efficiency",
                 "fuel_level_percentage", "predicted_consumption", "estimated_runtime"]


def _fmt(x: str, d: int) -> str:
    return f"printf('%.{d}f', round(({x}) * 1e{d}) / 1e{d})"


def _case(col: str, mapping: dict, default) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN {v}e0" for k, v in mapping.items())
    return f"CASE {whens} ELSE {default}e0 END"


def _acts(kind: str, col: str, levels) -> str:
    whens = " ".join(f"WHEN {col} = '{lv}' THEN '{'; '.join(I.ACTIONS[(kind, lv)])}'" for lv in levels)
    return f"CASE {whens} END"


LIMITS = I.DEFAULT_LIMITS
_typed = {k: v for k, v in LIMITS.efficiency.items() if k != "default"}
GOOD = _case("equipment_type", {k: v[0] for k, v in _typed.items()}, LIMITS.efficiency["default"][0])
AVERAGE = _case("equipment_type", {k: v[1] for k, v in _typed.items()}, LIMITS.efficiency["default"][1])
BASELINE = _case("equipment_type", I.BASELINE_EFFICIENCY, I.DEFAULT_BASELINE)

EFF_SQL = f"""SELECT 'efficiency' AS insight_type, CAST(NULL AS VARCHAR) AS subtype, priority, equipment_id, as_of,
  concat(CASE priority WHEN 'low' THEN 'Good' WHEN 'medium' THEN 'Average' ELSE 'Poor' END,
         ' fuel efficiency. Current average: ', {_fmt('avg_efficiency', 2)}, ' km/L.') AS message,
  ratio AS metric_value, {_acts('efficiency', 'priority', ['low', 'medium', 'high'])} AS actions
FROM (SELECT *, CASE WHEN ratio >= {GOOD} THEN 'low' WHEN ratio >= {AVERAGE} THEN 'medium' ELSE 'high' END AS priority
      FROM (SELECT *, avg_efficiency / {BASELINE} AS ratio FROM state WHERE n_efficiency >= {I.MIN_HISTORY}))"""

MAINT_SQL = f"""SELECT 'maintenance' AS insight_type, CAST(NULL AS VARCHAR) AS subtype, priority, equipment_id, as_of,
  CASE WHEN priority = 'high' THEN concat('Maintenance overdue. Hours since last service: ', {_fmt('hours_since_service', 1)})
       ELSE concat('Maintenance due soon. Hours since last service: ', {_fmt('hours_since_service', 1)}) END AS message,
  CASE WHEN priority = 'medium' THEN {LIMITS.service_due}e0 - hours_since_service ELSE hours_since_service END
    AS metric_value,
  {_acts('maintenance', 'priority', ['high', 'medium'])} AS actions
FROM (SELECT *, CASE WHEN hours_since_service >= {LIMITS.service_due}e0 THEN 'high' ELSE 'medium' END AS priority
      FROM state WHERE hours_since_service >= {LIMITS.service_warning}e0)"""

REFUEL_SQL = f"""SELECT 'refueling' AS insight_type, CAST(NULL AS VARCHAR) AS subtype, priority, equipment_id, as_of,
  CASE WHEN priority = 'high' THEN concat('Low fuel alert. Estimated runtime: ', {_fmt('estimated_runtime', 1)}, ' hours.')
       ELSE concat('Plan refueling soon. Estimated runtime: ', {_fmt('estimated_runtime', 1)}, ' hours.') END AS message,
  estimated_runtime AS metric_value, {_acts('refueling', 'priority', ['high', 'medium'])} AS actions
FROM (SELECT *, CASE WHEN fuel_level_percentage <= {LIMITS.low_fuel}e0 THEN 'high'
                     WHEN fuel_level_percentage <= {LIMITS.optimal_refuel}e0 AND estimated_runtime < 8 THEN 'medium' END
                  AS priority
      FROM state WHERE estimated_runtime IS NOT NULL AND estimated_runtime <> 0)
WHERE priority IS NOT NULL"""

IDLE_SQL = f"""SELECT 'idle' AS insight_type, CAST(NULL AS VARCHAR) AS subtype, 'medium' AS priority, equipment_id, as_of,
  concat('Excessive idle time detected. Idle ratio: ', {_fmt('ratio * 1e2', 1)}, '%') AS message,
  ratio AS metric_value, '{'; '.join(I.ACTIONS[('idle', 'medium')])}' AS actions
FROM (SELECT *, CAST(total_idle_time AS DOUBLE) / greatest(1, total_idle_time + total_active_time) AS ratio
      FROM state WHERE total_idle_time + total_active_time >= {I.MIN_HISTORY})
WHERE ratio > {LIMITS.idle_ratio}"""

_SUB = ("CASE WHEN contains(anomaly_type, 'Fuel Theft') THEN 'fuel_theft' WHEN contains(anomaly_type, 'Efficiency') "
        "THEN 'efficiency' WHEN contains(anomaly_type, 'Idle') THEN 'idle' WHEN contains(anomaly_type, 'Engine') "
        "OR contains(anomaly_type, 'Oil') OR contains(anomaly_type, 'Sensor') THEN 'mechanical' ELSE 'general' END")
ANOM_SQL = f"""SELECT 'anomaly' AS insight_type, subtype,
  CASE WHEN subtype IN ('fuel_theft', 'mechanical') THEN 'high' ELSE 'medium' END AS priority, equipment_id, as_of,
  CASE subtype
    WHEN 'fuel_theft' THEN concat('Potential fuel theft detected. Total missing: ', {_fmt('total_missing', 1)}, ' L')
    WHEN 'efficiency' THEN concat('Abnormal fuel efficiency detected. ', CAST(anomaly_count AS VARCHAR), ' instances.')
    WHEN 'idle' THEN concat('Excessive idle time detected. ', CAST(anomaly_count AS VARCHAR), ' instances.')
    WHEN 'mechanical' THEN concat(anomaly_type, ' detected. ', CAST(anomaly_count AS VARCHAR), ' instances.')
    ELSE concat(anomaly_type, ' anomaly detected. ', CAST(anomaly_count AS VARCHAR), ' instances.') END AS message,
  CASE WHEN subtype = 'fuel_theft' THEN total_missing ELSE CAST(anomaly_count AS DOUBLE) END AS metric_value,
  {_acts('anomaly', 'subtype', ['fuel_theft', 'efficiency', 'idle', 'mechanical', 'general'])} AS actions
FROM (SELECT r.*, s.as_of, {_SUB} AS subtype FROM rollup r JOIN state s USING (equipment_id)
      WHERE anomaly_type IS NOT NULL AND anomaly_type <> '' AND anomaly_type <> 'Unknown')"""

ALL_SQL = f"""SELECT *, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS priority_rank
FROM ({EFF_SQL}
UNION ALL {MAINT_SQL}
UNION ALL {REFUEL_SQL}
UNION ALL {IDLE_SQL}
UNION ALL {ANOM_SQL})"""


def _state(spark, sf_dir):
    return I.equipment_state(telemetry(spark, sf_dir))


def _anomaly_insights(spark, sf_dir, state):
    t = telemetry(spark, sf_dir)
    roll = A.anomaly_rollup(A.anomaly_rules(t, P.equipment_patterns(t)))
    return I.insights_anomaly(roll, state)


def all_insights(spark, sf_dir, config=None):
    """All families; ``config`` is the path of a threshold file (none: the defaults)."""
    limits = I.Limits.read(spark, config)
    # One row per unit, read by five insight families: materialise once.
    st = materialize_small(_state(spark, sf_dir))
    return I.insights_all(I.insights_efficiency(st, limits), I.insights_maintenance(st, limits), I.insights_refuel(st, limits),
                          I.insights_idle(st, limits), _anomaly_insights(spark, sf_dir, st))


@register("equipment_state", rnd(with_t("SELECT * FROM state", STATE_CTE), STATE_DOUBLES))
def equipment_state(spark, sf_dir):
    """IN1: latest row + counters + history summaries + runtime."""
    return _state(spark, sf_dir)


@register("reading_history", rnd(with_t("""
SELECT equipment_id, 'consumption' AS measure, ts, event_id, fuel_consumed AS value FROM t WHERE fuel_consumed > 0
UNION ALL SELECT equipment_id, 'efficiency', ts, event_id, fuel_efficiency FROM t WHERE fuel_efficiency > 0"""), ["value"]))
def reading_history(spark, sf_dir):
    """AG25: complete consumption and efficiency histories as rows."""
    return I.reading_history(telemetry(spark, sf_dir))


@register("runtime_from_models")
def runtime_from_models(spark, sf_dir):
    """JN6/AG22/IN1: runtime from the trained models' 24-hour forecasts."""
    from tankwise.plans.q_ml import _forecasts
    st = I.equipment_state(telemetry(spark, sf_dir), _forecasts(spark, sf_dir).select("equipment_id", "predicted_consumption"))
    return st.select("equipment_id", "fuel_level", "predicted_consumption", "estimated_runtime")


@register("insights_from_models")
def insights_from_models(spark, sf_dir):
    """IN4/IN7: all insight families with runtimes from the trained models' 24-hour forecasts."""
    from tankwise.plans.q_ml import _forecasts
    st = materialize_small(I.equipment_state(telemetry(spark, sf_dir),
                                             _forecasts(spark, sf_dir).select("equipment_id", "predicted_consumption")))
    return I.insights_all(I.insights_efficiency(st), I.insights_maintenance(st), I.insights_refuel(st), I.insights_idle(st),
                          _anomaly_insights(spark, sf_dir, st))


@register("estimated_runtime", rnd(with_t(
    "SELECT equipment_id, fuel_level, predicted_consumption, estimated_runtime FROM state", STATE_CTE),
    ["fuel_level", "predicted_consumption", "estimated_runtime"]))
def estimated_runtime(spark, sf_dir):
    """JN6/AG22/SC20: level / mean forecast when the mean is positive."""
    return _state(spark, sf_dir).select("equipment_id", "fuel_level", "predicted_consumption",
                                        "estimated_runtime")


@register("insights_efficiency", rnd(with_t(EFF_SQL, STATE_CTE), ["metric_value"]))
def insights_efficiency(spark, sf_dir):
    """IN2: efficiency grade per unit."""
    return I.insights_efficiency(_state(spark, sf_dir))


@register("insights_maintenance", rnd(with_t(MAINT_SQL, STATE_CTE), ["metric_value"]))
def insights_maintenance(spark, sf_dir):
    """IN3: overdue / due-soon service."""
    return I.insights_maintenance(_state(spark, sf_dir))


@register("insights_refuel", rnd(with_t(REFUEL_SQL, STATE_CTE), ["metric_value"]))
def insights_refuel(spark, sf_dir):
    """IN4: low fuel / plan refuelling."""
    return I.insights_refuel(_state(spark, sf_dir))


@register("insights_idle", rnd(with_t(IDLE_SQL, STATE_CTE), ["metric_value"]))
def insights_idle(spark, sf_dir):
    """IN5: excessive idle ratio."""
    return I.insights_idle(_state(spark, sf_dir))


@register("insights_anomaly", rnd(with_t(ANOM_SQL, STATE_CTE, *RULE_CTES, ROLLUP_CTE), ["metric_value"]))
def insights_anomaly(spark, sf_dir):
    """IN6: anomaly insights by type precedence."""
    return _anomaly_insights(spark, sf_dir, _state(spark, sf_dir))


@register("insights_all", rnd(with_t(ALL_SQL, STATE_CTE, *RULE_CTES, ROLLUP_CTE), ["metric_value"]))
def insights_all(spark, sf_dir):
    """IN7: all insight families with priority rank (high first)."""
    return all_insights(spark, sf_dir)


@register("insights_payload", with_t(f"""
SELECT equipment_id, CAST(count(*) AS BIGINT) AS n_insights,
  CAST(count_if(priority = 'high') AS BIGINT) AS n_high,
  string_agg(concat(priority, ':', message), ' | ' ORDER BY priority_rank, insight_type, subtype NULLS FIRST, message)
    AS rendered
FROM ({ALL_SQL}) GROUP BY equipment_id""", STATE_CTE, *RULE_CTES, ROLLUP_CTE))
def insights_payload(spark, sf_dir):
    """VW5: insights per unit (array of records + flat rendering)."""
    ins = all_insights(spark, sf_dir)
    item = F.struct("priority_rank", "insight_type", "subtype", "message", "priority")
    g = ins.groupBy("equipment_id").agg(F.sort_array(F.collect_list(item)).alias("items"),
                                        F.count_if(F.col("priority") == "high").cast("long").alias("n_high"))
    return g.select("equipment_id", F.size("items").cast("long").alias("n_insights"), "n_high",
                    F.array_join(F.transform("items", lambda x: F.concat(x["priority"], F.lit(":"), x["message"])),
                                 " | ").alias("rendered"), "items")


# Details of each family: (name, SQL text) by the rows that have them.
def _detail_rows(source: str, kind: str, subtype: str, pairs) -> str:
    names = ", ".join(f"'{n}'" for n, _ in pairs)
    return (f"SELECT '{kind}' AS insight_type, {subtype} AS subtype, equipment_id, unnest([{names}]) AS name, "
            f"unnest([{', '.join(x for _, x in pairs)}]) AS value FROM ({source})")


_EFF_ROWS = f"SELECT *, avg_efficiency / {BASELINE} AS ratio, {BASELINE} AS baseline FROM state WHERE n_efficiency >= {I.MIN_HISTORY}"
_NO = "CAST(NULL AS VARCHAR)"
_HOURS = [("hours_since_service", _fmt("hours_since_service", 4)), ("threshold", f"'{LIMITS.service_due:.4f}'")]
_FUEL = (f"SELECT * FROM state WHERE estimated_runtime IS NOT NULL AND estimated_runtime <> 0 AND (fuel_level_percentage <= {LIMITS.low_fuel}e0 "
         f"OR fuel_level_percentage <= {LIMITS.optimal_refuel}e0 AND estimated_runtime < 8)")
_IDLE = (f"SELECT * FROM (SELECT *, CAST(total_idle_time AS DOUBLE) / greatest(1, total_idle_time + total_active_time) AS ratio FROM state "
         f"WHERE total_idle_time + total_active_time >= {I.MIN_HISTORY}) WHERE ratio > {LIMITS.idle_ratio}")
_ANOM = (f"SELECT r.*, {_SUB} AS subtype FROM rollup r JOIN state s USING (equipment_id) "
         f"WHERE anomaly_type IS NOT NULL AND anomaly_type <> '' AND anomaly_type <> 'Unknown'")
_COUNT = ("anomaly_count", "CAST(anomaly_count AS VARCHAR)")
DETAILS_SQL = " UNION ALL ".join([
    _detail_rows(_EFF_ROWS, "efficiency", _NO, [(c, _fmt(c, 4)) for c in ("avg_efficiency", "baseline", "ratio")]),
    _detail_rows(f"SELECT * FROM state WHERE hours_since_service >= {LIMITS.service_warning}e0", "maintenance", _NO, _HOURS),
    _detail_rows(f"SELECT * FROM state WHERE hours_since_service >= {LIMITS.service_warning}e0 AND hours_since_service < {LIMITS.service_due}e0",
                 "maintenance", _NO, [("hours_remaining", _fmt(f"{LIMITS.service_due}e0 - hours_since_service", 4))]),
    _detail_rows(_FUEL, "refueling", _NO, [("fuel_percentage", _fmt("fuel_level_percentage", 4)), ("estimated_runtime", _fmt("estimated_runtime", 4)),
                                           ("fuel_level", _fmt("fuel_level", 4)), ("fuel_capacity", _fmt("tank_capacity", 4))]),
    _detail_rows(_IDLE, "idle", _NO, [("idle_time", "CAST(total_idle_time AS VARCHAR)"), ("active_time", "CAST(total_active_time AS VARCHAR)"),
                                      ("idle_ratio", _fmt("ratio", 4))]),
    _detail_rows(f"SELECT * FROM ({_ANOM}) WHERE subtype = 'fuel_theft'", "anomaly", "subtype",
                 [_COUNT, ("total_missing", _fmt("total_missing", 4)), ("locations", "locations")]),
    _detail_rows(f"SELECT * FROM ({_ANOM}) WHERE subtype <> 'fuel_theft'", "anomaly", "subtype",
                 [_COUNT, ("first_timestamp", "strftime(first_ts, '%Y-%m-%d %H:%M:%S')"), ("last_timestamp", "strftime(last_ts, '%Y-%m-%d %H:%M:%S')")])])


@register("insight_details", with_t(DETAILS_SQL, STATE_CTE, *RULE_CTES, ROLLUP_CTE))
def insight_details(spark, sf_dir):
    """IN2-IN6: the ``details`` map of every insight, exploded into rows."""
    return all_insights(spark, sf_dir).select("insight_type", "subtype", "equipment_id", F.explode("details").alias("name", "value"))


@register("insight_actions", with_t(f"""
SELECT insight_type, subtype, equipment_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS place, unnest(a) AS action
FROM (SELECT *, string_split(actions, '; ') AS a FROM ({ALL_SQL}))""", STATE_CTE, *RULE_CTES, ROLLUP_CTE))
def insight_actions(spark, sf_dir):
    """IN2-IN6: the recommended actions as an array, exploded in order."""
    return all_insights(spark, sf_dir).select("insight_type", "subtype", "equipment_id", F.posexplode("action_list").alias("place", "action"))


_4 = lambda x: f"CAST({_fmt(x, 4)} AS DOUBLE)"      # noqa: E731
FORMATTED_SQL = " UNION ALL ".join([
    f"""SELECT 'efficiency' AS insight_type, {_NO} AS subtype, equipment_id,
      concat(CASE WHEN {_4('ratio')} >= 8e-1 THEN 'Good' WHEN {_4('ratio')} >= 6e-1 THEN 'Average' ELSE 'Poor' END,
             ' fuel efficiency. Current average: ', {_fmt(_4('avg_efficiency'), 2)}, ' km/L.') AS text FROM ({_EFF_ROWS})""",
    f"""SELECT 'maintenance', {_NO}, equipment_id,
      CASE WHEN {_4('hours_since_service')} >= {LIMITS.service_due}e0 THEN concat('Maintenance overdue. Hours since last service: ',
             {_fmt(_4('hours_since_service'), 1)})
           ELSE concat('Maintenance due soon. Hours remaining: ', {_fmt(_4(f'{LIMITS.service_due}e0 - hours_since_service'), 1)}) END
      FROM state WHERE hours_since_service >= {LIMITS.service_warning}e0""",
    f"""SELECT 'refueling', {_NO}, equipment_id,
      concat(CASE WHEN {_4('fuel_level_percentage')} <= 10 THEN 'Critical fuel level.' WHEN {_4('fuel_level_percentage')} <= 20
             THEN 'Low fuel alert.' ELSE 'Plan refueling soon.' END, ' Estimated runtime: ', {_fmt(_4('estimated_runtime'), 1)}, ' hours.')
      FROM ({_FUEL})""",
    f"SELECT 'idle', {_NO}, equipment_id, 'Insight generated.' FROM ({_IDLE})",
    f"""SELECT 'anomaly', subtype, equipment_id,
      CASE subtype WHEN 'fuel_theft' THEN concat('Potential fuel theft detected. Total missing: ', {_fmt(_4('total_missing'), 1)}, ' L')
        WHEN 'efficiency' THEN concat('Abnormal fuel efficiency detected. ', anomaly_count, ' instances.')
        WHEN 'idle' THEN concat('Excessive idle time detected. ', anomaly_count, ' instances.')
        WHEN 'mechanical' THEN concat('Mechanical issue detected. ', anomaly_count, ' instances.')
        ELSE concat('Anomaly detected. ', anomaly_count, ' instances.') END FROM ({_ANOM})"""])


@register("insight_messages", with_t(FORMATTED_SQL, STATE_CTE, *RULE_CTES, ROLLUP_CTE))
def insight_messages(spark, sf_dir):
    """SC24: the message formatter's text of every typed record, from kind and details alone."""
    ins = all_insights(spark, sf_dir)
    return ins.select("insight_type", "subtype", "equipment_id", I.formatted(ins).alias("text"))
