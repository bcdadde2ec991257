"""Serving views (VW1-VW7, AG12-AG16, SNK5) as DataFrames.

Views return flat rows; nested payloads are one row per (unit, day) so no
single group grows with the full history of a unit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankwise.functions import scalar as S
from tankwise.operators.anomaly import detect_statistical
from tankwise.operators.sequence import PAGE, latest_by, max_scalar, paged, positions
from tankwise.sources.store import Store

NA_TEXT = "Data Not Available"


def latest_per_equipment(telemetry: DataFrame) -> DataFrame:
    return latest_by(telemetry)


def equipment_list(telemetry: DataFrame) -> DataFrame:
    """VW1/PRJ15: eight fields of each unit's latest row, NULL -> sentinel."""
    latest = latest_by(telemetry.select(
        "equipment_id", "ts", "event_id", "equipment_type", "driver_id", "fuel_level",
        "tank_capacity", "operational_status", "maintenance_status", "location"))
    fields = {"equipment_type": "equipment_type", "driver_id": "driver_id", "fuel_level": "fuel_level",
              "fuel_capacity": "tank_capacity", "operational_status": "operational_status",
              "maintenance_status": "maintenance_status", "location": "location"}
    return latest.select("equipment_id", *[
        F.coalesce(F.col(src).cast("string"), F.lit(NA_TEXT)).alias(out) for out, src in fields.items()])


def equipment_detail(telemetry: DataFrame, equipment_ids=None) -> DataFrame:
    """VW2/PRJ7: latest row plus history summary per requested unit.

    ``equipment_ids=None`` answers every unit; a list is a pushed-down
    equality/IN filter.  An unknown id yields no row ("not found").
    """
    t = telemetry
    if equipment_ids is not None:
        t = t.filter(F.col("equipment_id").isin(list(equipment_ids)))
    latest = latest_by(t.select("equipment_id", "ts", "event_id", "equipment_type", "fuel_level",
                                "fuel_consumed", "fuel_efficiency", "load_pct", "speed",
                                "operational_status", "maintenance_status"))
    latest = latest.select("equipment_id", F.col("ts").alias("latest_ts"), "equipment_type",
                           F.col("fuel_level").alias("latest_fuel_level"),
                           "operational_status", "maintenance_status")
    hist = t.groupBy("equipment_id").agg(
        F.count(F.lit(1)).cast("long").alias("history_points"),
        F.min("ts").alias("history_start"),
        F.avg("fuel_consumed").alias("avg_fuel_consumed"),
        F.avg("fuel_efficiency").alias("avg_fuel_efficiency"),
        F.avg("load_pct").alias("avg_load"), F.avg("speed").alias("avg_speed"))
    return latest.join(hist, "equipment_id")


# Columns of a unit's served history, after the time.
HISTORY_COLUMNS = ["fuel_consumed", "fuel_level", "fuel_efficiency", "load_pct", "speed"]


def equipment_history(telemetry: DataFrame, size: int = PAGE) -> DataFrame:
    """VW2, the history: per (unit, page) the readings' time and five figures in order."""
    d = positions(telemetry.select("equipment_id", "ts", "event_id", *HISTORY_COLUMNS))
    return paged(d, ["equipment_id"], ["ts", *HISTORY_COLUMNS], "history", size)


def equipment_record(telemetry: DataFrame) -> DataFrame:
    """VW2, the latest reading: every field as text in a map, NULL (and NaN) as the sentinel."""
    latest = latest_by(telemetry)
    def text(f):
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
        return F.coalesce(c.cast("string"), F.lit(NA_TEXT))
    fields = [f for f in latest.schema.fields if f.name != "equipment_id"]
    pairs = [x for f in fields for x in (F.lit(f.name), text(f))]
    return latest.select("equipment_id", F.create_map(*pairs).alias("latest"))


def equipment_lookup(store: Store, ids: list[str]) -> DataFrame:
    """PRJ7: readings, first and latest time and latest level of the asked units; an
    unknown id has a row that says so.  Only the units' row groups are read."""
    spark = store.spark
    asked = spark.createDataFrame([(i,) for i in sorted(set(ids))], "equipment_id string")
    found = store.units(ids).groupBy("equipment_id").agg(
        F.count(F.lit(1)).alias("readings"), F.min("ts").alias("first_ts"), F.max("ts").alias("latest_ts"),
        F.max_by("fuel_level", F.struct("ts", "event_id")).alias("latest_fuel_level"))
    return F.broadcast(asked).join(found, "equipment_id", "left").withColumn(
        "found", F.col("readings").isNotNull()).withColumn("readings", F.coalesce("readings", F.lit(0)))


def nested_payload(telemetry: DataFrame, size: int = PAGE) -> DataFrame:
    """SNK5: per (unit, day, page) the ordered readings (ts, consumption, level).

    A page holds at most ``size`` readings, so no array grows with a unit's day.
    Returns the array column ``history`` plus flat summaries (count, first and
    last ts, rounded sum and a text rendering) for value comparison.
    """
    d = positions(telemetry.select("equipment_id", "ts", "event_id", "fuel_consumed", "fuel_level"), per_day=True)
    g = paged(d.withColumn("date", F.to_date("ts")), ["equipment_id", "date"], ["ts", "event_id", "fuel_consumed", "fuel_level"],
              "history", size)
    text = F.array_join(F.transform("history", lambda x: F.concat(
        F.date_format(x["ts"], "HH:mm:ss"), F.lit("="), F.round(x["fuel_consumed"], 2).cast("string"))), ",")
    return g.select("equipment_id", "date", "page", "history",
                    F.size("history").cast("long").alias("n_items"),
                    F.col("history")[0]["ts"].alias("first_ts"),
                    F.element_at("history", -1)["ts"].alias("last_ts"),
                    F.aggregate("history", F.lit(0.0), lambda acc, x: acc + x["fuel_consumed"]).alias("sum_consumed"),
                    text.alias("rendered"))


def recent_events(store: Store, hours: int = 24) -> DataFrame:
    return store.trailing(hours=hours).drop("date")


def dashboard_equipment(telemetry: DataFrame) -> DataFrame:
    """VW6 (per-unit part): status row per unit + last_updated."""
    latest = latest_by(telemetry.select("equipment_id", "ts", "event_id", "equipment_type",
                                        "operational_status", "fuel_level", "tank_capacity",
                                        "location", "maintenance_status"))
    return latest.select(
        "equipment_id", "equipment_type", "operational_status",
        S.half_even(F.col("fuel_level") / F.col("tank_capacity") * 100.0, 1).alias("fuel_level_pct"),
        "location", "maintenance_status",
        F.lit(max_scalar(telemetry.select("ts"), "ts")).alias("last_updated"))


def dashboard_summary(telemetry: DataFrame, store: Store, bounds: DataFrame | None = None) -> DataFrame:
    """VW6 (summary): AG13 counts on latest rows, AG14 trailing-24h fuel sum,
    and anomalies in the trailing 24 h by the statistical detector's bounds.
    The trailing parts read the last date folders only."""
    latest = latest_by(telemetry.select("equipment_id", "ts", "event_id", "operational_status",
                                        "maintenance_status", "fuel_level", "tank_capacity"))
    a = latest.agg(
        F.count(F.lit(1)).cast("long").alias("total_equipment"),
        F.count_if(F.col("operational_status") == "Running").cast("long").alias("active_equipment"),
        F.count_if(F.col("maintenance_status") == "Needs Service").cast("long").alias("maintenance_needed"),
        F.count_if(F.col("fuel_level") / F.col("tank_capacity") < 0.2).cast("long").alias("low_fuel_count"))
    recent = store.trailing(hours=24)
    fuel = recent.agg(S.half_even(F.coalesce(F.sum("fuel_consumed"), F.lit(0.0)), 2)).scalar()
    out = a.withColumn("total_fuel_consumed", fuel)
    if bounds is not None:
        rec = detect_statistical(recent, bounds).filter("stat_anomaly")
        out = out.withColumn("anomaly_count_24h", rec.agg(F.count(F.lit(1)).cast("long")).scalar())
    return out.withColumn("last_updated", F.lit(store.last_time()))


def consumption_history(store: Store, days: int = 7) -> DataFrame:
    """VW7/AG15: mean consumption per (type, day) over the trailing ``days``."""
    t = store.trailing(days=days).select("equipment_type", "date", "fuel_consumed")
    return (t.filter(F.col("equipment_type").isNotNull())
             .groupBy("equipment_type", "date").agg(F.avg("fuel_consumed").alias("fuel_consumed")))


def dataset_summary(telemetry: DataFrame) -> DataFrame:
    """AG12: time range, distinct units, row count (one partial aggregate)."""
    return telemetry.agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
                         F.count_distinct("equipment_id").cast("long").alias("n_equipment"),
                         F.count(F.lit(1)).cast("long").alias("n_rows"))


def distinct_types(telemetry: DataFrame) -> DataFrame:
    """PRJ17: distinct equipment types, in order."""
    return (telemetry.select("equipment_type").filter(F.col("equipment_type").isNotNull()).distinct()
            .orderBy("equipment_type"))


def type_counts(telemetry: DataFrame) -> DataFrame:
    """AG16: value counts of equipment type, descending."""
    return (telemetry.filter(F.col("equipment_type").isNotNull()).groupBy("equipment_type")
                     .agg(F.count(F.lit(1)).cast("long").alias("n")).orderBy(F.desc("n"), "equipment_type"))
