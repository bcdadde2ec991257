"""Equipment state and prioritised insights (IN1-IN7, AG18-AG25, SC24).

The reference updates a per-unit Python dict row by row; here the state is
one grouped aggregate (partial, skew-safe) joined with the latest row, and
each insight family is a projection + filter over that state.  Insights are
stamped with the data's ``as_of`` time (max ts), never the wall clock.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tankwise.functions import scalar as S
from tankwise.operators.sequence import latest_by, max_scalar, trailing
from tankwise.sources.files import DEFAULT_CONFIG, read_config

BASELINE_EFFICIENCY = {"Truck": 6.0, "Bulldozer": 3.0, "Forklift": 8.0}
DEFAULT_BASELINE = 5.0
MIN_HISTORY = 5
PRIORITY_RANK = {"high": 0, "medium": 1, "low": 2}


@dataclass(frozen=True)
class Limits:
    """Thresholds of the insight families, from one configuration document (SRC6)."""
    efficiency: dict          # type -> (good, average, poor), with a ``default``
    service_due: float
    service_warning: float
    idle_ratio: float
    low_fuel: float
    optimal_refuel: float

    @classmethod
    def of(cls, config: dict) -> Limits:
        return cls({k: tuple(float(t[c]) for c in ("good", "average", "poor")) for k, t in config["efficiency_thresholds"].items()},
                   float(config["maintenance_thresholds"]["service_due_hours"]),
                   float(config["maintenance_thresholds"]["service_warning_hours"]),
                   float(config["idle_thresholds"]["daily_idle_ratio"]), float(config["refuel_thresholds"]["low_fuel_percentage"]),
                   float(config["refuel_thresholds"]["optimal_refuel_percentage"]))

    @classmethod
    def read(cls, spark, path: str | None) -> Limits:
        """From a configuration file (``read_config``: the defaults if there is none)."""
        return cls.of(read_config(spark, path).first().asDict(recursive=True))

    def cut(self, place: int) -> Column:
        """Cut-off of the row's type: 0 good, 1 average, 2 poor."""
        return S.map_literal("equipment_type", {k: v[place] for k, v in self.efficiency.items() if k != "default"},
                             self.efficiency["default"][place])


DEFAULT_LIMITS = Limits.of(DEFAULT_CONFIG)

# Fixed values (must equal the reference's): message texts by kind, with the place of
# the figure; the last block holds the variants of the message formatter.
MESSAGES = {
    ("efficiency", "low"): "Good fuel efficiency. Current average: %s km/L.",
    ("efficiency", "medium"): "Average fuel efficiency. Current average: %s km/L.",
    ("efficiency", "high"): "Poor fuel efficiency. Current average: %s km/L.",
    ("maintenance", "high"): "Maintenance overdue. Hours since last service: %s",
    ("maintenance", "medium"): "Maintenance due soon. Hours since last service: %s",
    ("refueling", "high"): "Low fuel alert. Estimated runtime: %s hours.",
    ("refueling", "medium"): "Plan refueling soon. Estimated runtime: %s hours.",
    ("idle", "medium"): "Excessive idle time detected. Idle ratio: %s%%",
    ("anomaly", "fuel_theft"): "Potential fuel theft detected. Total missing: %s L",
    ("anomaly", "efficiency"): "Abnormal fuel efficiency detected. %s instances.",
    ("anomaly", "idle"): "Excessive idle time detected. %s instances.",
    ("anomaly", "mechanical"): "%s detected. %s instances.",
    ("anomaly", "general"): "%s anomaly detected. %s instances.",
    ("maintenance", "remaining"): "Maintenance due soon. Hours remaining: %s",
    ("refueling", "critical"): "Critical fuel level. Estimated runtime: %s hours.",
    ("anomaly", "any mechanical"): "Mechanical issue detected. %s instances.",
    ("anomaly", "any"): "Anomaly detected. %s instances.",
    ("any", "any"): "Insight generated.",
}


def say(kind: str, variant: str, *figures) -> Column:
    return F.format_string(MESSAGES[kind, variant], *figures)


def details(**figures) -> Column:
    """Map of names to texts; numbers with four decimals, counts as they are."""
    return F.create_map(*[x for k, v in figures.items() for x in (F.lit(k), v)])

# Fixed values (must equal the reference's): recommended actions per insight kind.
ACTIONS = {
    ("efficiency", "low"): ["Maintain current operating practices."],
    ("efficiency", "medium"): ["Consider reducing idle time", "Check for proper maintenance"],
    ("efficiency", "high"): ["Schedule maintenance check", "Review operator behavior",
                             "Check for mechanical issues"],
    ("maintenance", "high"): ["Schedule immediate maintenance", "Inspect for potential issues"],
    ("maintenance", "medium"): ["Plan for upcoming maintenance", "Schedule service in the next few days"],
    ("refueling", "high"): ["Refuel immediately", "Plan route to nearest refueling station"],
    ("refueling", "medium"): ["Schedule refueling today", "Consider refueling at the end of the shift"],
    ("idle", "medium"): ["Review operator behavior", "Consider auto-shutdown when idle",
                         "Optimize work scheduling to reduce idle time"],
    ("anomaly", "fuel_theft"): ["Investigate fuel usage patterns", "Check equipment security",
                                "Review refueling procedures"],
    ("anomaly", "efficiency"): ["Check for mechanical issues", "Inspect fuel quality",
                                "Review operator behavior"],
    ("anomaly", "idle"): ["Implement idle reduction policies", "Train operators on efficient practices",
                          "Consider auto-shutdown systems"],
    ("anomaly", "mechanical"): ["Schedule diagnostic check", "Inspect equipment for issues",
                                "Prepare maintenance"],
    ("anomaly", "general"): ["Investigate anomaly pattern", "Monitor equipment performance",
                             "Document occurrences"],
}

INSIGHT_COLUMNS = ["insight_type", "subtype", "priority", "equipment_id", "as_of", "message",
                   "metric_value", "actions", "details", "action_list"]


def fmt(x: Column, digits: int) -> Column:
    """Fixed-point text of a rounded number (round first: no tie ambiguity)."""
    scale = float(10 ** digits)
    return F.format_string(f"%.{digits}f", F.round(x * F.lit(scale)) / F.lit(scale))


def _action_list(kind: str, level_col: Column, levels) -> Column:
    expr = None
    for lv in levels:
        arr = F.array(*[F.lit(a) for a in ACTIONS[(kind, lv)]])
        expr = F.when(level_col == lv, arr) if expr is None else expr.when(level_col == lv, arr)
    return expr


def _record(rows: DataFrame, kind: str, priority: Column, message: Column, metric: Column, figures: Column,
            actions: Column, subtype: Column | None = None) -> DataFrame:
    """The columns of an insight, the same for all families."""
    return rows.select(F.lit(kind).alias("insight_type"), (F.lit(None).cast("string") if subtype is None else subtype).alias("subtype"),
                       priority.alias("priority"), "equipment_id", "as_of", message.alias("message"), metric.alias("metric_value"),
                       F.array_join(actions, "; ").alias("actions"), figures.alias("details"), actions.alias("action_list"))


# --------------------------------------------------------------- IN1
def forecast_proxy(telemetry: DataFrame, hours: int = 24) -> DataFrame:
    """Stand-in forecast: each unit's mean consumption over the trailing day
    (relative to the data max).  Shape of the forecast frame."""
    t = trailing(telemetry.select("equipment_id", "ts", "fuel_consumed"), "ts", hours=hours,
                 anchor=telemetry)
    return t.select("equipment_id", "ts", F.col("fuel_consumed").alias("predicted_consumption"))


def equipment_state(telemetry: DataFrame, forecasts: DataFrame | None = None) -> DataFrame:
    """IN1: latest row + idle/active counters + histories + runtime.

    Counters aggregate over all rows (defect Q11 fixed).  The families need only
    counts and means of the histories; the histories themselves are rows
    (``reading_history``), as a unit's list has no bound.  ``forecasts`` are the
    models' hourly predictions (default: the trailing day's readings).
    """
    latest = latest_by(telemetry.select(
        "equipment_id", "ts", "event_id", "equipment_type", "fuel_level", "tank_capacity",
        "operational_status", "maintenance_status", "hours_since_service"))
    running = F.col("operational_status") == "Running"
    counters = telemetry.groupBy("equipment_id").agg(
        F.count_if(running & (F.col("idle_time") > 0)).cast("long").alias("total_idle_time"),
        F.count_if(running & ~F.coalesce(F.col("idle_time") > 0, F.lit(False))).cast("long")
         .alias("total_active_time"),
        F.count_if(F.col("fuel_consumed") > 0).cast("long").alias("n_consumption"),
        F.avg(F.when(F.col("fuel_consumed") > 0, F.col("fuel_consumed"))).alias("avg_consumption"),
        F.count_if(F.col("fuel_efficiency") > 0).cast("long").alias("n_efficiency"),
        F.avg(F.when(F.col("fuel_efficiency") > 0, F.col("fuel_efficiency"))).alias("avg_efficiency"),
        F.max(F.when(F.col("refuel_event") == "Yes", F.col("ts"))).alias("last_refuel"),
    )
    st = latest.join(counters, "equipment_id")
    st = st.withColumns({
        "fuel_level_percentage": F.col("fuel_level") / F.col("tank_capacity") * 100.0,
        "last_update": F.col("ts"),
    })
    if forecasts is None:
        forecasts = forecast_proxy(telemetry)
    rt = estimated_runtime(st, forecasts)
    return rt.withColumn("as_of", max_scalar(telemetry.select("ts"), "ts"))


def reading_history(telemetry: DataFrame) -> DataFrame:
    """AG25: every positive reading of consumption and efficiency of every unit, one
    row each."""
    parts = [telemetry.where(F.col(c) > 0).select("equipment_id", F.lit(name).alias("measure"), "ts", "event_id",
                                                  F.col(c).alias("value"))
             for name, c in (("consumption", "fuel_consumed"), ("efficiency", "fuel_efficiency"))]
    return parts[0].unionAll(parts[1])


def recent_history(telemetry: DataFrame, col: str, name: str, k: int) -> DataFrame:
    """Each unit's last ``k`` positive readings of ``col`` as an ordered
    array of (ts, value).  ``row_number() <= k`` is planned as a map-side
    group limit, so at most k rows per unit and partition are shuffled."""
    w = Window.partitionBy("equipment_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    top = (telemetry.filter(F.col(col) > 0).select("equipment_id", "ts", "event_id", col)
                    .withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k))
    return top.groupBy("equipment_id").agg(
        F.sort_array(F.collect_list(F.struct("ts", F.col(col).alias("value")))).alias(name))


def persist_insights(insights: DataFrame, path: str) -> None:
    """SNK4: insights as Parquet partitioned by priority (readers prune)."""
    insights.write.mode("overwrite").partitionBy("priority").parquet(path)


def estimated_runtime(state: DataFrame, forecasts: DataFrame) -> DataFrame:
    """JN6/AG22: mean forecast per unit; runtime = level / mean if mean > 0.
    Forecasts of units absent from ``state`` are ignored (left join)."""
    f = forecasts.groupBy("equipment_id").agg(F.avg("predicted_consumption").alias("predicted_consumption"))
    j = state.join(f, "equipment_id", "left")
    return j.withColumn("estimated_runtime", S.runtime_hours(F.col("fuel_level"),
                                                             F.col("predicted_consumption")))


# --------------------------------------------------------------- IN2-IN5
def insights_efficiency(state: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """IN2: ratio of mean positive efficiency to the type baseline, graded by
    the type's cut-offs (the ``default`` ones when the type has none)."""
    baseline = S.map_literal("equipment_type", BASELINE_EFFICIENCY, DEFAULT_BASELINE)
    s = state.filter(F.col("n_efficiency") >= MIN_HISTORY).withColumn("ratio", F.col("avg_efficiency") / baseline)
    pr = F.when(F.col("ratio") >= limits.cut(0), "low").when(F.col("ratio") >= limits.cut(1), "medium").otherwise("high")
    s = s.withColumn("priority", pr)
    p, mean = F.col("priority"), fmt(F.col("avg_efficiency"), 2)
    msg = (F.when(p == "low", say("efficiency", "low", mean)).when(p == "medium", say("efficiency", "medium", mean))
           .otherwise(say("efficiency", "high", mean)))
    return _record(s, "efficiency", p, msg, F.col("ratio"),
                   details(avg_efficiency=fmt(F.col("avg_efficiency"), 4), baseline=fmt(baseline, 4), ratio=fmt(F.col("ratio"), 4)),
                   _action_list("efficiency", p, ["low", "medium", "high"]))


def insights_maintenance(state: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """IN3: >= 500 h overdue (high); >= 450 h due soon (medium)."""
    h, due = F.col("hours_since_service"), F.lit(limits.service_due)
    s = state.filter(h >= limits.service_warning).withColumn("priority", F.when(h >= due, "high").otherwise("medium"))
    p = F.col("priority")
    msg = F.when(p == "high", say("maintenance", "high", fmt(h, 1))).otherwise(say("maintenance", "medium", fmt(h, 1)))
    both = details(hours_since_service=fmt(h, 4), threshold=fmt(due, 4))
    return _record(s, "maintenance", p, msg, F.when(p == "medium", due - h).otherwise(h),
                   F.when(p == "high", both).otherwise(F.map_concat(both, details(hours_remaining=fmt(due - h, 4)))),
                   _action_list("maintenance", p, ["high", "medium"]))


def insights_refuel(state: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """IN4: needs a non-zero runtime; <= 20 % high; <= 25 % and < 8 h medium."""
    pct, rt = F.col("fuel_level_percentage"), F.col("estimated_runtime")
    s = state.filter(rt.isNotNull() & (rt != 0))
    pr = F.when(pct <= limits.low_fuel, "high").when((pct <= limits.optimal_refuel) & (rt < 8), "medium")
    s = s.withColumn("priority", pr).filter(F.col("priority").isNotNull())
    p = F.col("priority")
    msg = F.when(p == "high", say("refueling", "high", fmt(rt, 1))).otherwise(say("refueling", "medium", fmt(rt, 1)))
    return _record(s, "refueling", p, msg, rt,
                   details(fuel_percentage=fmt(pct, 4), estimated_runtime=fmt(rt, 4), fuel_level=fmt(F.col("fuel_level"), 4),
                           fuel_capacity=fmt(F.col("tank_capacity"), 4)),
                   _action_list("refueling", p, ["high", "medium"]))


def insights_idle(state: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """IN5/AG20: idle / max(1, total) over running rows; total >= 5, ratio > 0.3."""
    idle, act = F.col("total_idle_time"), F.col("total_active_time")
    total = idle + act
    ratio = idle / F.greatest(F.lit(1), total)
    s = state.filter(total >= MIN_HISTORY).withColumn("ratio", ratio.cast("double")).filter(
        F.col("ratio") > limits.idle_ratio)
    return _record(s, "idle", F.lit("medium"), say("idle", "medium", fmt(F.col("ratio") * 100.0, 1)), F.col("ratio"),
                   details(idle_time=idle.cast("string"), active_time=act.cast("string"), idle_ratio=fmt(F.col("ratio"), 4)),
                   _action_list("idle", F.lit("medium"), ["medium"]))


# --------------------------------------------------------------- IN6
def insights_anomaly(rollup: DataFrame, state: DataFrame) -> DataFrame:
    """IN6: per (unit, anomaly type) by substring precedence.  Units absent
    from the state are ignored (JN7).  The times of the anomalies are rows of
    ``anomaly.anomaly_times``; a record holds their number, first and last."""
    t = F.col("anomaly_type")
    sub = (F.when(t.contains("Fuel Theft"), "fuel_theft").when(t.contains("Efficiency"), "efficiency")
           .when(t.contains("Idle"), "idle")
           .when(t.contains("Engine") | t.contains("Oil") | t.contains("Sensor"), "mechanical")
           .otherwise("general"))
    r = (rollup.filter(t.isNotNull() & (t != "") & (t != "Unknown"))
               .join(state.select("equipment_id", "as_of"), "equipment_id", "inner")
               .withColumn("subtype", sub))
    n, st, missing = F.col("anomaly_count").cast("string"), F.col("subtype"), F.col("total_missing")
    msg = (F.when(st == "fuel_theft", say("anomaly", "fuel_theft", fmt(missing, 1)))
           .when(st == "efficiency", say("anomaly", "efficiency", n)).when(st == "idle", say("anomaly", "idle", n))
           .when(st == "mechanical", say("anomaly", "mechanical", t, n)).otherwise(say("anomaly", "general", t, n)))
    pr = F.when(st.isin("fuel_theft", "mechanical"), "high").otherwise("medium")
    metric = F.when(st == "fuel_theft", missing).otherwise(F.col("anomaly_count").cast("double"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")      # noqa: E731
    figures = F.when(st == "fuel_theft", details(anomaly_count=n, total_missing=fmt(missing, 4), locations=F.col("locations"))).otherwise(
        details(anomaly_count=n, first_timestamp=at("first_ts"), last_timestamp=at("last_ts")))
    return _record(r, "anomaly", pr, msg, metric, figures,
                   _action_list("anomaly", st, ["fuel_theft", "efficiency", "idle", "mechanical", "general"]), st)


def formatted(insights: DataFrame) -> Column:
    """SC24: the message of a typed record from its kind and details alone."""
    d = lambda name: F.element_at("details", F.lit(name)).cast("double")      # noqa: E731
    kind, st, n = F.col("insight_type"), F.coalesce("subtype", F.lit("general")), F.element_at("details", F.lit("anomaly_count"))
    mean, run = fmt(d("avg_efficiency"), 2), fmt(d("estimated_runtime"), 1)
    efficiency = (F.when(d("ratio") >= 0.8, say("efficiency", "low", mean)).when(d("ratio") >= 0.6, say("efficiency", "medium", mean))
                  .otherwise(say("efficiency", "high", mean)))
    hours, due = d("hours_since_service"), d("threshold")
    service = F.when(hours >= due, say("maintenance", "high", fmt(hours, 1))).otherwise(
        say("maintenance", "remaining", fmt(F.coalesce(d("hours_remaining"), due - hours), 1)))
    pct = d("fuel_percentage")
    fuel = (F.when(pct <= 10, say("refueling", "critical", run)).when(pct <= 20, say("refueling", "high", run))
            .otherwise(say("refueling", "medium", run)))
    anomaly = (F.when(st == "fuel_theft", say("anomaly", "fuel_theft", fmt(d("total_missing"), 1)))
               .when(st == "efficiency", say("anomaly", "efficiency", n)).when(st == "idle", say("anomaly", "idle", n))
               .when(st == "mechanical", say("anomaly", "any mechanical", n)).otherwise(say("anomaly", "any", n)))
    return (F.when(kind == "efficiency", efficiency).when(kind == "maintenance", service).when(kind == "refueling", fuel)
            .when(kind == "anomaly", anomaly).otherwise(F.lit(MESSAGES["any", "any"])))


# --------------------------------------------------------------- IN7
def insights_all(*parts: DataFrame) -> DataFrame:
    """IN7: union of the families with a priority rank (high first, defect Q8
    fixed), in output order."""
    cols = [c for c in INSIGHT_COLUMNS if all(c in p.columns for p in parts)]
    u = parts[0].select(*cols)
    for p in parts[1:]:
        u = u.unionByName(p.select(*cols))
    rank = S.map_literal("priority", PRIORITY_RANK, 3)
    return order_insights(u.withColumn("priority_rank", rank.cast("int")))


def order_insights(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("priority_rank").asc(), F.col("as_of").desc(), "equipment_id",
                      "insight_type", "subtype")
