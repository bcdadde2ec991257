"""Per-type equipment profile and per-reading labels (JN2-JN4, SC13-SC16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankwise.functions import scalar as S
from tankwise.operators.joins import join_checked

# Fixed defaults when a type has no efficiency / emissions row.
DEFAULT_EFFICIENCY = {"efficiency_combined": 5.0, "efficiency_city": 4.0, "efficiency_highway": 6.0}
DEFAULT_EMISSIONS = {"base_emissions": 200.0, "emissions_std": 20.0}


def equipment_profile(types: DataFrame, efficiency: DataFrame, engine_emissions: DataFrame,
                      consumption: DataFrame) -> DataFrame:
    """JN2/JN3/SC16 (+JN4 result): one profile row per equipment type.

    ``types`` holds distinct types; the three lookups are per-type or
    per-engine tables joined with defaults by ``coalesce``.
    """
    eff = efficiency.select("equipment_type",
                            F.col("combined_efficiency_km_per_l").alias("_comb"),
                            F.col("city_efficiency_km_per_l").alias("_city"),
                            F.col("highway_efficiency_km_per_l").alias("_hwy"))
    p = types.withColumns({"vehicle_class": S.vehicle_class("equipment_type"),
                           "engine_type": S.engine_type("equipment_type")})
    p = join_checked(p, eff, "equipment_type", "left")
    em = engine_emissions.select("engine_type", F.col("mean_emissions").alias("_em"),
                                 F.col("std_emissions").alias("_es"))
    p = join_checked(p, em, "engine_type", "left")
    p = join_checked(p, consumption.select("equipment_type", F.col("consumption").alias("consumption_per_100km")),
                     "equipment_type", "left")
    return p.select(
        "equipment_type", "vehicle_class", "engine_type",
        F.coalesce("_comb", F.lit(DEFAULT_EFFICIENCY["efficiency_combined"])).alias("efficiency_combined"),
        F.coalesce("_city", F.lit(DEFAULT_EFFICIENCY["efficiency_city"])).alias("efficiency_city"),
        F.coalesce("_hwy", F.lit(DEFAULT_EFFICIENCY["efficiency_highway"])).alias("efficiency_highway"),
        "consumption_per_100km",
        F.coalesce("_em", F.lit(DEFAULT_EMISSIONS["base_emissions"])).alias("base_emissions"),
        F.coalesce("_es", F.lit(DEFAULT_EMISSIONS["emissions_std"])).alias("emissions_std"))


def status_labels(df: DataFrame) -> DataFrame:
    """SC13-SC15: maintenance label from hours, gear from speed (N unless
    running and not idling), event note by precedence."""
    moving = (F.col("operational_status") == "Running") & ~F.coalesce(F.col("idle_time") > 0, F.lit(False))
    d = df.withColumn("maintenance_label", S.maintenance_status("hours_since_service"))
    return d.withColumns({
        "gear_label": S.gear_from_speed("speed", moving),
        "note_label": S.event_note(status="maintenance_label"),
    })
