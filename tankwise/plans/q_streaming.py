"""Registered jobs: Structured Streaming replays (build step 11).

Each job stages ``events`` as time-ordered chunks, replays them through the
stream with ``availableNow`` and returns the sink; the oracle is the batch
SQL of the same job (closed windows only for append-mode windows).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tankwise.operators import anomaly as A
from tankwise.plans.q_anomaly import RULE_CASES
from tankwise.plans.q_views import LATEST_SQL, SIGMA_CTE
from tankwise.plans.registry import register, rnd, with_t
from tankwise.session import scratch_path
from tankwise.sources.tables import telemetry
from tankwise.sources.upserts import Published
from tankwise.streaming import jobs as J


@register("stream_equipment_state", rnd(with_t("""
SELECT l.equipment_id, l.ts, l.event_id, l.equipment_type, l.fuel_level, l.operational_status, l.maintenance_status,
  c.total_idle_time, c.total_active_time, c.n_readings
FROM latest l JOIN (
  SELECT equipment_id,
    CAST(count_if(operational_status = 'Running' AND idle_time > 0) AS BIGINT) AS total_idle_time,
    CAST(count_if(operational_status = 'Running' AND NOT coalesce(idle_time > 0, false)) AS BIGINT) AS total_active_time,
    CAST(count(*) AS BIGINT) AS n_readings
  FROM t GROUP BY equipment_id) c USING (equipment_id)""", f"latest AS ({LATEST_SQL})"), ["fuel_level"]))
def stream_equipment_state(spark, sf_dir):
    """ST1: streaming latest state and counters (update mode into a versioned upsert table)."""
    return J.replay(spark, sf_dir, J.run_equipment_state, "state", reader=lambda s, out: J.state_table(s, out).read())


@register("stream_consumption_daily", rnd(with_t("""
SELECT * FROM (
  SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, equipment_type,
    CAST(avg(CAST(fuel_consumed AS DECIMAL(18, 6))) AS DOUBLE) AS avg_consumption, CAST(count(*) AS BIGINT) AS n
  FROM t GROUP BY 1, 2, 3)
WHERE window_end <= (SELECT max(ts) FROM t) - INTERVAL 1 HOUR"""), ["avg_consumption"]))
def stream_consumption_daily(spark, sf_dir):
    """ST2: watermarked tumbling daily means by type (append, closed windows)."""
    return J.replay(spark, sf_dir, J.run_consumption_daily, "daily")


@register("stream_consumption_sliding", rnd(with_t("""
SELECT * FROM (
  SELECT s AS window_start, s + INTERVAL 24 HOUR AS window_end, equipment_type,
    sum(fuel_consumed) AS total_consumed, CAST(count(*) AS BIGINT) AS n
  FROM (SELECT equipment_type, fuel_consumed, date_trunc('hour', ts) - to_hours(k) AS s FROM t, range(0, 24) r(k))
  GROUP BY 1, 2, 3)
WHERE window_end <= (SELECT max(ts) FROM t) - INTERVAL 1 HOUR"""), ["total_consumed"]))
def stream_consumption_sliding(spark, sf_dir):
    """ST3: trailing-24h sums sliding hourly (append, closed windows)."""
    return J.replay(spark, sf_dir, J.run_consumption_sliding, "sliding")


_LAGLESS = [(n, c) for n, c in RULE_CASES if n in J.LAGLESS_RULES]
ALERTS_SQL = f"""
SELECT event_id, equipment_id, ts, alert FROM (
  SELECT t.event_id, t.equipment_id, t.ts,
    list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _LAGLESS)},
      CASE WHEN length(stat_fired) > 0 THEN concat('Statistical:', stat_fired) END], lambda k: k IS NOT NULL) AS kinds
  FROM t JOIN (SELECT event_id, concat_ws(',',
      CASE WHEN fuel_consumed < fc_mu - 3e0 * fc_sd OR fuel_consumed > fc_mu + 3e0 * fc_sd THEN 'fuel_consumed' END,
      CASE WHEN fuel_efficiency < fe_mu - 3e0 * fe_sd OR fuel_efficiency > fe_mu + 3e0 * fe_sd THEN 'fuel_efficiency' END,
      CASE WHEN engine_temp < et_mu - 3e0 * et_sd OR engine_temp > et_mu + 3e0 * et_sd THEN 'engine_temp' END,
      CASE WHEN oil_pressure < op_mu - 3e0 * op_sd OR oil_pressure > op_mu + 3e0 * op_sd THEN 'oil_pressure' END)
      AS stat_fired FROM t JOIN bounds USING (equipment_type)) s USING (event_id)) x,
LATERAL (SELECT unnest(x.kinds) AS alert)"""


@register("stream_alerts", with_t(ALERTS_SQL, SIGMA_CTE))
def stream_alerts(spark, sf_dir):
    """ST4: per-type bounds, newest version per micro-batch, + lag-free rules."""
    t = telemetry(spark, sf_dir)
    bounds = Published(spark, scratch_path(spark, "bounds"))
    bounds.publish(A._wide_bounds(A.sigma_thresholds(A.unannotated(t)), "equipment_type", A.SIGMA_METRICS))
    return J.replay(spark, sf_dir, lambda s, o, c: J.run_alerts(s, bounds, o, c), "alerts", reader=J.alerts_table)


@register("stream_fuel_drop", rnd(with_t("""
SELECT event_id, equipment_id, ts, prev_level, fuel_level, fuel_consumed,
  (prev_level - fuel_consumed) - fuel_level AS missing
FROM (SELECT *, lag(fuel_level) OVER (PARTITION BY equipment_id ORDER BY ts, event_id) AS prev_level FROM t)
WHERE refuel_event <> 'Yes' AND prev_level IS NOT NULL AND prev_level - fuel_consumed > 0
  AND (prev_level - fuel_consumed) - fuel_level >= 1e-1 * (prev_level - fuel_consumed)"""),
    ["prev_level", "fuel_level", "fuel_consumed", "missing"]))
def stream_fuel_drop(spark, sf_dir):
    """ST5: fuel-drop alerts from keyed state with event-time timers."""
    return J.replay(spark, sf_dir, J.run_fuel_drop, "fueldrop", heartbeat=dt.timedelta(hours=3))


@register("stream_dedup", with_t("SELECT event_id, equipment_id, ts FROM t"))
def stream_dedup(spark, sf_dir):
    """ST6: resent readings dropped within the watermark; each reading appears once."""
    def resend(max_ts):
        return (F.col("ts") >= F.lit(max_ts) - F.expr("INTERVAL 1 DAY")) & (F.col("event_id") % 7 == 0)
    return J.replay(spark, sf_dir, J.run_dedup, "dedup", resend_filter=resend)
