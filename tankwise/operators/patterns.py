"""Reference-data pattern tables (AG1-AG11, JN1, JN4, JN5, SC1, SC2, SC27).

Each function is one aggregate job over its input; no loops of jobs.  Outputs
are small (per type / per calendar key / per bin) and are the dimension
tables the profile and anomaly stages join against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankwise.functions import scalar as S
from tankwise.operators.selection import exact_median
from tankwise.operators.joins import join_checked, join_literal_dim

# --------------------------------------------------------------- PRJ1-PRJ3
ECONOMY_COLUMNS = ["year", "make", "model", "VClass", "displ", "cylinders", "trany",
                   "city08", "highway08", "comb08", "fuelType"]


def select_existing(df: DataFrame, wanted=ECONOMY_COLUMNS) -> DataFrame:
    """PRJ1: keep the expected columns that exist; all columns if none do."""
    have = [c for c in wanted if c in df.columns]
    return df.select(*have) if have else df


def resolve_alias(columns, aliases):
    """PRJ2: first alias present in ``columns`` (metadata only)."""
    return next((a for a in aliases if a in columns), None)


def resolve_substring(columns, *needles):
    """PRJ3: first column whose lower-cased name contains any needle."""
    return next((c for c in columns if any(n in c.lower() for n in needles)), None)


# --------------------------------------------------------------- AG11 / SC2
def unit_flag(df: DataFrame, col: str, threshold: float = 15.0) -> DataFrame:
    """AG11, the decision: is the exact median of ``col`` above ``threshold``?

    Decided from one partial aggregate (counts and the two values around the
    threshold) instead of buffering all values: for an even count whose two
    middle values straddle the threshold, their mean decides.
    """
    x = F.col(col)
    agg = df.agg(
        F.count(x).alias("n"),
        F.count_if(x > threshold).alias("n_above"),
        F.max(F.when(x <= threshold, x)).alias("lo_max"),
        F.min(F.when(x > threshold, x)).alias("hi_min"),
    )
    n, a = F.col("n"), F.col("n_above")
    is_mpg = (F.when(n % 2 == 1, a >= (n + 1) / 2)
              .when(a >= n / 2 + 1, F.lit(True))
              .when(a == n / 2, (F.col("lo_max") + F.col("hi_min")) > 2 * threshold)
              .otherwise(F.lit(False)))
    return agg.select(F.col("n").cast("long").alias("n"), F.col("n_above").cast("long").alias("n_above"), is_mpg.alias("is_mpg"))


def unit_detection(df: DataFrame, col: str, threshold: float = 15.0) -> DataFrame:
    """AG11: the decision with the median it rests on, found by rank search."""
    _, median = exact_median(df, col)
    return unit_flag(df, col, threshold).withColumn("median_value", F.lit(median).cast("double"))


def unit_conversion(df: DataFrame, city: str, highway: str, combined: str, is_mpg) -> DataFrame:
    """SC1/SC2: km/L and L/100 km for city, highway and combined figures."""
    out = {}
    for name, c in (("city", city), ("highway", highway), ("combined", combined)):
        out[f"{name}_efficiency_km_per_l"] = S.efficiency_from_combined(F.col(c), is_mpg)
        out[f"{name}_consumption_l_per_100km"] = S.consumption_from_combined(F.col(c), is_mpg)
    return df.withColumns(out)


# --------------------------------------------------------------- AG1 / JN5
EFFICIENCY_MEASURES = ["city_efficiency_km_per_l", "highway_efficiency_km_per_l",
                       "combined_efficiency_km_per_l", "city_consumption_l_per_100km",
                       "highway_consumption_l_per_100km", "combined_consumption_l_per_100km"]


def equipment_efficiency(economy: DataFrame) -> DataFrame:
    """AG1 (with PRJ1-3, JN5, AG11, SC1-2): mean efficiency per equipment type."""
    df = select_existing(economy)
    vclass = resolve_alias(df.columns, ["VClass", "Vehicle Class", "vehicle_class"])
    city = resolve_substring(df.columns, "city")
    hwy = resolve_substring(df.columns, "highway", "hwy")
    comb = resolve_substring(df.columns, "comb")
    df = df.withColumn("equipment_type", S.class_to_equipment(F.col(vclass)))
    is_mpg = unit_flag(df, comb).select("is_mpg").scalar()   # scalar subquery
    df = unit_conversion(df, city, hwy, comb, is_mpg)
    return df.groupBy("equipment_type").agg(*[F.avg(m).alias(m) for m in EFFICIENCY_MEASURES])


# --------------------------------------------------------------- AG2
def cylinder_efficiency(df: DataFrame, key: str = "cylinders", mpg: str = "mpg") -> DataFrame:
    """AG2: mean and sample std of mpg and km/L per key."""
    kmpl = S.mpg_to_km_per_l(F.col(mpg))
    return (df.filter(F.col(key).isNotNull())
              .groupBy(key).agg(F.avg(mpg).alias("mpg_mean"), F.stddev_samp(mpg).alias("mpg_std"),
                                F.avg(kmpl).alias("fuel_efficiency_km_per_l_mean"),
                                F.stddev_samp(kmpl).alias("fuel_efficiency_km_per_l_std")))


# --------------------------------------------------------------- AG9 / AG10
def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """AG10: least-squares slope and intercept in one aggregate pass."""
    return df.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                  F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
                  F.regr_count(F.col(y), F.col(x)).cast("long").alias("n"))


def bin_table(spark, edges) -> DataFrame:
    """Literal half-open bins [edges[i], edges[i+1]) (size = len(edges)-1)."""
    rows = [(float(edges[i]), float(edges[i + 1]), f"{edges[i]}-{edges[i + 1]}")
            for i in range(len(edges) - 1)]
    return spark.createDataFrame(rows, "lo double, hi double, bin string")


def bin_average(df: DataFrame, x: str, y: str, edges) -> DataFrame:
    """AG9/PRJ8: mean of y per half-open bin of x; empty bin -> OLS at the midpoint.

    The bin id is computed arithmetically when edges are evenly spaced, so the
    data side needs no range join; the bin dimension is the left side so empty
    bins survive.
    """
    spark = df.sparkSession
    bins = bin_table(spark, edges)
    step = edges[1] - edges[0]
    even = all(edges[i + 1] - edges[i] == step for i in range(len(edges) - 1))
    xs = F.col(x)
    inside = (xs >= float(edges[0])) & (xs < float(edges[-1]))
    if even:
        lo = (F.lit(float(edges[0])) + F.floor((xs - edges[0]) / step) * step).cast("double")
    else:
        lo = None
        for i in range(len(edges) - 2, -1, -1):
            cond = xs >= float(edges[i])
            lo = F.when(cond, F.lit(float(edges[i]))) if lo is None else lo.when(cond, F.lit(float(edges[i])))
    binned = (df.filter(inside).withColumn("lo", lo)
                .groupBy("lo").agg(F.avg(y).alias("avg_y"), F.count(F.lit(1)).alias("n")))
    line = regression_line(df, x, y)
    slope, intercept = line.select("slope").scalar(), line.select("intercept").scalar()
    out = (bins.join(binned, "lo", "left")
               .withColumn("value", F.coalesce(F.col("avg_y"),
                                               intercept + slope * (F.col("lo") + F.col("hi")) / 2)))
    return out.select("lo", "hi", "bin", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
                      "avg_y", "value")


# Fixed weight classes per equipment type (kg) and the default consumption.
WEIGHT_CLASS = {"heavy": (3000, 4000), "medium": (2000, 3000), "light": (1000, 2000)}
HEAVY_TYPES = ["Bulldozer", "Excavator", "Crane"]
MEDIUM_TYPES = ["Loader", "Truck", "Tractor"]
DEFAULT_BIN_CONSUMPTION = 20.0


def weight_class_range(equipment_type, scale: float = 1.0):
    t = F.col(equipment_type) if isinstance(equipment_type, str) else equipment_type
    lo = (F.when(t.isin(HEAVY_TYPES), WEIGHT_CLASS["heavy"][0])
          .when(t.isin(MEDIUM_TYPES), WEIGHT_CLASS["medium"][0])
          .otherwise(WEIGHT_CLASS["light"][0])) / F.lit(scale)
    hi = (F.when(t.isin(HEAVY_TYPES), WEIGHT_CLASS["heavy"][1])
          .when(t.isin(MEDIUM_TYPES), WEIGHT_CLASS["medium"][1])
          .otherwise(WEIGHT_CLASS["light"][1])) / F.lit(scale)
    return lo.cast("double"), hi.cast("double")


def range_lookup(types: DataFrame, bins: DataFrame, scale: float = 1.0) -> DataFrame:
    """JN4 with defect Q5 fixed: the bin that contains the class midpoint.

    ``bins`` comes from ``bin_average`` (literal bin count, so the broadcast
    size is fixed); non-equi join ``lo <= mid < hi``; default when no bin.
    """
    lo, hi = weight_class_range("equipment_type", scale)
    t = types.withColumns({"class_lo": lo, "class_hi": hi}).withColumn(
        "class_mid", (F.col("class_lo") + F.col("class_hi")) / 2)
    b = F.broadcast(bins.select(F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"),
                                F.col("value").alias("b_value")))
    j = t.join(b, (F.col("class_mid") >= F.col("b_lo")) & (F.col("class_mid") < F.col("b_hi")), "left")
    return j.select("equipment_type", "class_lo", "class_hi", "class_mid",
                    F.coalesce(F.col("b_value"), F.lit(DEFAULT_BIN_CONSUMPTION)).alias("consumption"))


# --------------------------------------------------------------- JN1, AG3-AG5
def daily_pct_of_max(df: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """JN1/AG3: each reading as percent of its calendar day's maximum.

    Expressed as a join of the rows with the per-day max aggregate (partial,
    so a hot day does not land in one task); the per-day table is counted
    before it is broadcast, so the readings are never shuffled by day.
    """
    d = df.withColumn("date", F.to_date(F.col(ts)))
    daily = d.groupBy("date").agg(F.max(value).alias("daily_max"))
    # One row per calendar day: counted, then broadcast (no shuffle of the readings).
    j = join_checked(d, daily, "date", "inner")
    return j.withColumns({
        "hour": F.hour(ts).cast("int"),
        "weekday": S.weekday_mon0(F.col(ts)),
        "month": F.month(ts).cast("int"),
        "is_weekend": (S.weekday_mon0(F.col(ts)) >= 5).cast("int"),
        "consumption_pct": F.col(value) / F.col("daily_max") * 100.0,
    })


def hourly_profile(pct: DataFrame) -> DataFrame:
    """AG4: mean/std of percent-of-daily-max by hour."""
    return pct.groupBy("hour").agg(F.avg("consumption_pct").alias("mean_consumption_pct"),
                                   F.stddev_samp("consumption_pct").alias("std_consumption_pct"))


def calendar_profile(pct: DataFrame) -> DataFrame:
    """AG5: weekday / month / weekend profiles in one pass (grouping sets)."""
    g = pct.groupingSets([["weekday"], ["month"], ["is_weekend"]], "weekday", "month", "is_weekend")
    r = g.agg(F.avg("consumption_pct").alias("mean_consumption_pct"),
              F.stddev_samp("consumption_pct").alias("std_consumption_pct"),
              F.grouping_id().alias("_gid"))
    # grouping_id bits follow (weekday, month, is_weekend), 1 = not grouped.
    period = (F.when(F.col("_gid") == 3, "weekday")
              .when(F.col("_gid") == 5, "month").otherwise("weekend"))
    key = F.coalesce(F.col("weekday"), F.col("month"), F.col("is_weekend")).cast("int")
    return r.select(period.alias("period"), key.alias("key"), "mean_consumption_pct",
                    "std_consumption_pct")


def activity_factor(rows: DataFrame, hourly: DataFrame, calendar: DataFrame,
                    ts: str = "ts") -> DataFrame:
    """SC27 with defect Q3 fixed: integer keys; missing key -> 0.5 each.

    The three factor tables are bounded by their calendar domains (24, 7 and
    12 keys), so broadcasting them is size-safe.
    """
    h = hourly.select(F.col("hour").alias("_h"), (F.col("mean_consumption_pct") / 100.0).alias("hour_factor"))
    wd = calendar.filter(F.col("period") == "weekday").select(
        F.col("key").alias("_wd"), (F.col("mean_consumption_pct") / 100.0).alias("weekday_factor"))
    mo = calendar.filter(F.col("period") == "month").select(
        F.col("key").alias("_mo"), (F.col("mean_consumption_pct") / 100.0).alias("month_factor"))
    r = rows.withColumns({"_h": F.hour(ts).cast("int"), "_wd": S.weekday_mon0(F.col(ts)),
                          "_mo": F.month(ts).cast("int")})
    r = join_literal_dim(r, h, "_h")
    r = join_literal_dim(r, wd, "_wd")
    r = join_literal_dim(r, mo, "_mo")
    r = r.withColumns({c: F.coalesce(F.col(c), F.lit(0.5))
                       for c in ("hour_factor", "weekday_factor", "month_factor")})
    return r.withColumn("activity_factor", F.col("hour_factor") * F.col("weekday_factor")
                        * F.col("month_factor")).drop("_h", "_wd", "_mo")


# --------------------------------------------------------------- AG6 / AG7
def emissions_by_fuel(df: DataFrame, fuel: str, emissions: str) -> DataFrame:
    """AG6 + SC18: mean/std of emissions per fuel label, with engine group."""
    g = df.filter(F.col(fuel).isNotNull()).groupBy(fuel).agg(
        F.avg(emissions).alias("mean_emissions"), F.stddev_samp(emissions).alias("std_emissions"))
    return g.withColumn("engine_type", S.fuel_type_group(F.col(fuel)))


def emissions_by_engine(by_fuel: DataFrame) -> DataFrame:
    """AG7: unweighted mean of the per-fuel means and stds per engine type."""
    return by_fuel.groupBy("engine_type").agg(F.avg("mean_emissions").alias("mean_emissions"),
                                              F.avg("std_emissions").alias("std_emissions"))


# --------------------------------------------------------------- AG8
# Fixed metric list: (telemetry column, short name, default when absent/all-null).
PROFILE_METRICS = [
    ("fuel_consumed", "fuel_consumed", 10.0), ("load_pct", "load", 50.0), ("rpm", "rpm", 1500.0),
    ("speed", "speed", 20.0), ("fuel_efficiency", "fuel_efficiency", 5.0),
    ("emission_rate", "emission_rate", 200.0), ("idle_time", "idle_time", 10.0),
    ("tank_capacity", "fuel_tank_capacity", 100.0),
]


def equipment_patterns(df: DataFrame, group: str = "equipment_type") -> DataFrame:
    """AG8: per type x metric mean, max(0.1, std), min, max; defaults when the
    column is absent or all null.  One unpivot + one grouped aggregate."""
    present = [(c, s) for c, s, _ in PROFILE_METRICS if c in df.columns]
    base = df.filter(F.col(group).isNotNull())
    stats = None
    if present:
        long = base.select(group, *[F.col(c).cast("double").alias(s) for c, s in present]).unpivot(
            group, [s for _, s in present], "metric", "value")
        stats = long.groupBy(group, "metric").agg(
            F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_std"),
            F.min("value").alias("_min"), F.max("value").alias("_max"))
    # Every type gets one row per fixed metric (literal array, no join).
    metric_defaults = F.array(*[F.struct(F.lit(s).alias("metric"), F.lit(d).alias("default"))
                                for _, s, d in PROFILE_METRICS])
    types = base.select(group).distinct()
    grid = types.select(group, F.explode(metric_defaults).alias("_m")).select(group, "_m.metric", "_m.default")
    out = grid.join(stats, [group, "metric"], "left") if stats is not None else grid
    has = F.col("_mean").isNotNull() if stats is not None else F.lit(False)
    d = F.col("default")
    return out.select(
        group, "metric",
        F.when(has, F.col("_mean")).otherwise(d).alias("mean"),
        F.when(has, F.greatest(F.lit(0.1), F.col("_std"))).otherwise(d * 0.1).alias("std"),
        F.when(has, F.col("_min")).otherwise(d * 0.5).alias("min"),
        F.when(has, F.col("_max")).otherwise(d * 1.5).alias("max"))
