"""Feature engineering over telemetry (SC3-SC12, WN3-WN9, FT1).

All per-equipment windows share one partitioning ``(equipment_id, _chunk)``
and one ordering ``(ts, event_id)``, so the full feature table costs a single
data shuffle plus one sort; the halo rows make the chunked windows exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tankwise.functions import scalar as S
from tankwise.operators import sequence as SQ
from tankwise.operators.sequence import (DEFAULT_ORDER, _bounded, chunk_window, range_halo_chunks,
                                         same, series_chunks)

ROLL_FRAMES = (6, 12, 24)
ROLL_MEASURES = {"consumption": "fuel_consumed", "load": "load_pct", "speed": "speed"}
LAG_MEASURES = {"prev_fuel_level": "fuel_level", "prev_load": "load_pct", "prev_rpm": "rpm"}
# The categoricals' levels.  A level outside the list has the
# column ``<name>_other`` set, so no row is all zeros without notice.
ONEHOT_LEVELS = {
    "equipment_type": ["Bulldozer", "Crane", "Excavator", "Forklift", "Generator", "Loader", "Truck"],
    "gear": ["1", "2", "3", "4", "5", "D", "N", "R"],
    "driving_mode": ["Eco", "N/A", "Normal", "Power"],
    "operational_status": ["Idle", "Running", "Stopped"],
    "maintenance_status": ["Due", "Needs Service", "Normal", "Not Due", "Recently Serviced", "Service Due Soon"],
}
OTHER = "other"


def with_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns(S.calendar_columns(ts))


def with_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(S.flag_columns())


def _lag_cols(w) -> dict:
    out = {}
    for name, src in LAG_MEASURES.items():
        lagged = F.lag(src, 1).over(w)
        # Fill rule SC10 with defect Q4 fixed: missing previous -> current value.
        out[name] = F.coalesce(lagged, F.col(src))
    out["fuel_level_change"] = F.coalesce(F.col("fuel_level") - F.lag("fuel_level", 1).over(w),
                                          F.lit(0.0))
    return out


def _roll_cols(w) -> dict:
    out = {}
    for n in ROLL_FRAMES:
        frame = w.rowsBetween(-(n - 1), 0)
        for short, src in ROLL_MEASURES.items():
            avg = F.avg(src).over(frame)
            # WN6 gate: a frame of n rows exists only for units with >= n rows;
            # otherwise (and for an all-null frame) the current value is used.
            out[f"avg_{short}_{n}h"] = F.coalesce(
                F.when(F.col("_n_key") >= n, avg), F.col(src))
    return out


def _finish(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_halo")).drop("_halo", "_chunk", "_n_key")


def with_lags(df: DataFrame, key: str = "equipment_id",
              order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    """WN3/WN4 + fill rules: previous level/load/RPM and level change."""
    c = series_chunks(df, key, order, halo_rows=1)
    return _finish(c.withColumns(_lag_cols(chunk_window(key, order))))


def with_rolling(df: DataFrame, key: str = "equipment_id",
                 order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    """WN5/WN6: 6/12/24-row trailing means of consumption, load and speed."""
    c = series_chunks(df, key, order, halo_rows=max(ROLL_FRAMES) - 1)
    return _finish(c.withColumns(_roll_cols(chunk_window(key, order))))


def with_onehot(df: DataFrame, levels: dict | None = None) -> DataFrame:
    """SC11: one 0/1 column per listed level and one for any other level (no pivot
    job, no vocabulary scan)."""
    levels = levels or ONEHOT_LEVELS
    cols = {}
    for c, vals in levels.items():
        for v in vals:
            cols[onehot_name(c, v)] = (F.col(c) == F.lit(v)).cast("int")
        cols[onehot_name(c, OTHER)] = (~F.col(c).isin(vals)).cast("int")
    return df.withColumns(cols)


def onehot_name(col: str, level: str) -> str:
    safe = "".join(ch if ch.isalnum() else "_" for ch in level.lower())
    return f"{col}_{safe}"


def with_windows(df: DataFrame, key: str = "equipment_id", order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    """WN3-WN6: lags and rolling means.  Both families use the same chunks and the
    same ordering, so Spark plans one Exchange and one Sort for all of them."""
    c = series_chunks(df, key, order, halo_rows=max(ROLL_FRAMES) - 1)
    w = chunk_window(key, order)
    return _finish(c.withColumns({**_lag_cols(w), **_roll_cols(w)}))


def features_all(df: DataFrame, key: str = "equipment_id",
                 order: Sequence[str] = DEFAULT_ORDER, onehot: bool = True) -> DataFrame:
    """FT1: calendar + flags + lags + rolling means + one-hot in one pass."""
    out = with_flags(with_calendar(with_windows(df, key, order)))
    return with_onehot(out) if onehot else out


REACH_HOURS = 3


def with_avg_load_3h(df: DataFrame, key: str = "equipment_id", ts: str = "ts") -> DataFrame:
    """WN8 re-aim: mean load over the trailing 3 hours (time range, inclusive).

    A unit whose days are small has one window a day; a unit with a day of more than
    ``CHUNK_ROWS`` readings is answered by prefix sums over slices of its days."""
    day = df.groupBy(key, SQ.bucket_of(ts).alias("_day")).agg(F.count(F.lit(1)).alias("_rows"))
    hot, few = _bounded(day.where(F.col("_rows") > SQ.CHUNK_ROWS).select(key).distinct())
    if hot.isEmpty():
        return _mean_by_day(df, key, ts)
    hot = F.broadcast(hot) if few else hot
    return _mean_by_day(same(df, hot, [key], "left_anti"), key, ts).unionByName(
        mean_by_prefix_sums(same(df, hot, [key], "left_semi"), key, ts))


def _mean_by_day(df: DataFrame, key: str, ts: str) -> DataFrame:
    c = range_halo_chunks(df, key, ts, reach_hours=REACH_HOURS)
    # Range frames need a numeric or timestamp order key; microseconds keep
    # the frame exact and inclusive.
    w = (Window.partitionBy(key, "_chunk")
         .orderBy(F.unix_micros(F.col(ts).cast("timestamp")))
         .rangeBetween(-REACH_HOURS * 3600 * 1_000_000, 0))
    out = c.withColumn("avg_load_3h", F.avg("load_pct").over(w))
    return out.filter(~F.col("_halo")).drop("_halo", "_chunk")


def mean_by_prefix_sums(df: DataFrame, key: str = "equipment_id", ts: str = "ts") -> DataFrame:
    """The same mean, with no frame held anywhere.

    Readings of one instant share their frame, so they are summed first.  The frame's
    sum is the unit's running sum at the instant less the running sum before the
    frame's edge; edges are laid into the series as entries without a value (before
    readings of the same time), the series is cut into slices of about ``CHUNK_ROWS``
    entries, and a slice adds the sum of all earlier slices of its unit.  Sums are
    decimals, so differences of large sums lose nothing."""
    exact = F.col("load_pct").cast("decimal(20,9)")
    instants = df.groupBy(key, ts).agg(F.sum(exact).alias("_s"), F.count("load_pct").alias("_n"))
    timed = instants.where(F.col(ts).isNotNull())
    zero = F.lit(0)
    edges = timed.select(key, (F.col(ts) - F.make_dt_interval(zero, F.lit(REACH_HOURS))).alias("_t"), zero.alias("_kind"),
                         F.col(ts).alias("_at"), zero.cast("decimal(30,9)").alias("_s"), zero.cast("long").alias("_n"))
    points = timed.select(key, F.col(ts).alias("_t"), F.lit(1).alias("_kind"), F.col(ts).alias("_at"),
                          F.coalesce(F.col("_s").cast("decimal(30,9)"), zero.cast("decimal(30,9)")).alias("_s"), "_n")
    series = SQ.with_buckets(points.unionByName(edges), key, ("_t",))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts, few = _bounded(series.groupBy(key, "_b").agg(F.sum("_s").cast("decimal(38,9)").alias("_s"), F.sum("_n").alias("_n"))
                           .select(key, "_b", F.coalesce(F.sum("_s").over(earlier).cast("decimal(38,9)"), zero).alias("_s0"),
                                   F.coalesce(F.sum("_n").over(earlier), zero).alias("_n0")))
    run = Window.partitionBy(key, "_b").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    running = series.select(key, "_b", "_kind", "_at", F.sum("_s").over(run).alias("_rs"), F.sum("_n").over(run).alias("_rn"))
    running = same(running, F.broadcast(starts) if few else starts, [key, "_b"])
    total = lambda kind, c, c0: F.max(F.when(F.col("_kind") == kind, F.col(c) + F.col(c0)))      # noqa: E731
    both = running.groupBy(key, "_at").agg(total(1, "_rs", "_s0").alias("_hs"), total(0, "_rs", "_s0").alias("_ls"),
                                           total(1, "_rn", "_n0").alias("_hn"), total(0, "_rn", "_n0").alias("_ln"))
    n = F.col("_hn") - F.col("_ln")
    means = both.select(key, F.col("_at").alias(ts), F.when(n > 0, (F.col("_hs") - F.col("_ls")).cast("double") / n).alias("avg_load_3h"))
    untimed = instants.where(F.col(ts).isNull()).select(
        key, ts, F.when(F.col("_n") > 0, F.col("_s").cast("double") / F.col("_n")).alias("avg_load_3h"))
    return same(df, means.unionByName(untimed), [key, ts])


def derived_efficiency(df: DataFrame) -> DataFrame:
    """SC19: distance from speed and idle minutes; km/L guarded."""
    dist = S.distance_km("speed", "idle_time")
    return df.withColumns({
        "distance_calc": dist,
        "efficiency_calc": S.efficiency_km_per_l(dist, F.col("fuel_consumed")),
    })
