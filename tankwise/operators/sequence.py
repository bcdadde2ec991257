"""Per-entity ordered operations that stay correct and balanced under skew.

A naive ``Window.partitionBy(equipment_id)`` sends every row of one unit to a
single task; if one unit holds a third of the data that task holds a third of
the data.  The helpers here instead

* compute "latest row" as a partial (map-side) aggregate (``max_by``),
* split each entity's series into time buckets (finer where one holds many rows)
  and copy the few rows a row
  frame needs from earlier buckets ("halo" rows), so ordered windows run per
  ``(entity, bucket)``; only a per-bucket count table and at most ``halo``
  rows per bucket take part in the bookkeeping joins,
* derive global positions (ordered split) from per-(entity, bucket) counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ORDER = ("ts", "event_id")


def _order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def latest_by(df: DataFrame, key: str = "equipment_id",
              order: Sequence[str] = DEFAULT_ORDER, max_keys: int | None = None,
              method: str = "semi") -> DataFrame:
    """WN1: one row per key, the one with the greatest ``order`` tuple.

    ``max_by`` with a struct payload can only run as a sort-based aggregate
    (a full local sort of the input).  So first a hash aggregate finds each
    key's latest timestamp (fixed-width buffer, partial before the shuffle),
    the per-key table is materialised and counted, and -- when it is small
    enough to broadcast -- a broadcast semi join keeps only rows at that
    timestamp; ``max_by`` then breaks ties on the remaining order columns
    over those few rows.  With more keys than ``max_keys`` the sort-based
    aggregate is used directly (still partial, still skew-safe).

    The two-pass form reads ``df`` twice, which suits scans.  When ``df`` is
    itself expensive (e.g. the output of window pipelines) pass
    ``method="sort"``: one pass, map-side partial sort aggregate.
    """
    from tankwise.operators.joins import BROADCAST_MAX_ROWS, materialize_small
    limit = BROADCAST_MAX_ROWS if max_keys is None else max_keys
    ts = order[0]
    cand = df
    if method == "sort":
        mx = None
    else:
        mx = materialize_small(df.groupBy(key).agg(F.max(ts).alias("_latest_ts")))
    if mx is not None and mx.count() <= limit:
        m = F.broadcast(mx.withColumnRenamed(key, "_latest_key"))
        cand = df.join(m, (F.col(key) == F.col("_latest_key")) & (F.col(ts) == F.col("_latest_ts")),
                       "left_semi")
    rest = [c for c in df.columns if c != key]
    return (cand.groupBy(key)
                .agg(F.max_by(F.struct(*rest), _order_struct(order)).alias("_latest"))
                .select(key, "_latest.*"))


def max_scalar(df: DataFrame, col: str) -> Column:
    """Scalar subquery ``(SELECT max(col) FROM df)`` usable inside filters."""
    return df.agg(F.max(col)).scalar()


def trailing(df: DataFrame, ts: str = "ts", hours: int | None = 24, days: int | None = None,
             as_of=None, anchor: DataFrame | None = None) -> DataFrame:
    """PRJ9/JN11: rows with ``ts >= max(ts) - N`` (inclusive).

    ``as_of`` may be a literal (timestamp / string); then the filter reaches
    the Parquet scan and skips row groups.  Without it the cut-off is a scalar
    subquery over the ts column of ``anchor`` (default: ``df``) -- one cheap
    pruned scan, no join of data-sized sides.
    """
    if days is not None:
        delta = F.make_dt_interval(F.lit(days))
    else:
        delta = F.make_dt_interval(F.lit(0), F.lit(hours))
    src = anchor if anchor is not None else df
    cut = F.lit(as_of) if as_of is not None else max_scalar(src.select(ts), ts)
    return df.filter(F.col(ts) >= cut - delta)


CHUNK_ROWS = 100_000     # rows of one entity and day from which the day is cut into finer buckets
PARTS = 1 << 26          # buckets that a day can be cut into
MOST_CUTS = 4096         # quantiles of a day, at most; 256 unless a day needs more


def same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the right side's keys are dropped."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    out = left.join(r, on, how)
    return out if how == "left_semi" else out.drop(*[f"_r_{c}" for c in keys])


def bucket_of(ts: str, bucket_days: int = 1) -> Column:
    """Day bucket; rows without a time come before all others, as in their order."""
    day = F.floor(F.unix_date(F.to_date(F.col(ts))) / F.lit(bucket_days)).cast("long")
    return F.coalesce(day, F.lit(-(1 << 30)))


def with_buckets(df: DataFrame, key: str, order: Sequence[str], bucket_days: int = 1) -> DataFrame:
    """``_b``: an entity's consecutive buckets, ascending in its order.

    A bucket is a day; a day of an entity with more than ``CHUNK_ROWS`` rows is
    cut at quantiles of the order (time, then the next order column), found by one
    partial aggregate over the hot days only, into buckets of about that size."""
    ts, tie = order[0], order[1] if len(order) > 1 else None
    d = df.withColumn("_day", bucket_of(ts, bucket_days))
    n = d.groupBy(key, "_day").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > CHUNK_ROWS)
    hot, few = _bounded(n)
    if hot.isEmpty():
        return d.withColumnRenamed("_day", "_b").withColumn("_b", F.col("_b") * PARTS)
    widest = hot.agg(F.max("_rows")).first()[0]
    cuts_of = 256
    while cuts_of < min(MOST_CUTS, -(-widest // CHUNK_ROWS)):
        cuts_of *= 2
    hot = F.broadcast(hot) if few else hot
    inside = same(d, hot, [key, "_day"])
    places, accuracy = [i / cuts_of for i in range(1, cuts_of)], max(10_000, 8 * cuts_of)
    micros = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(0))
    share = F.lit(CHUNK_ROWS).cast("double") / F.col("_rows")
    sampled = inside.groupBy(key, "_day").agg(
        F.percentile_approx(micros, places, accuracy).alias("_cut"),
        *([F.percentile_approx(tie, places, accuracy).alias("_tie")] if tie else []),
        F.first(F.ceil(1 / share)).alias("_want"))
    step = F.greatest(F.lit(1), F.floor(F.lit(cuts_of) / F.col("_want")).cast("int"))
    keep = lambda c: F.array_distinct(F.filter(c, lambda x, i: (i + 1) % step == 0))     # noqa: E731
    cuts, few = _bounded(sampled.select(key, "_day", keep("_cut").alias("_cut"),
                                        (keep("_tie") if tie else F.array().cast("array<bigint>")).alias("_tie")))
    d = same(d, F.broadcast(cuts) if few else cuts, [key, "_day"], "left")
    below = lambda c, v: F.size(F.filter(c, lambda x: x < v))      # noqa: E731
    # between cuts: an even place; the rows of one instant that is itself a cut
    # come in between and are told apart by the next order column
    at_cut = cuts_of + F.least(F.lit(cuts_of - 1), below("_tie", F.col(tie)) if tie else F.lit(0))
    part = F.when(F.col("_cut").isNull(), 0).otherwise(
        below("_cut", micros) * (2 * cuts_of) + F.when(F.array_contains("_cut", micros), at_cut).otherwise(0))
    return d.withColumn("_b", F.col("_day") * PARTS + part).drop("_day", "_cut", "_tie")


def halo_chunks(df: DataFrame, key: str = "equipment_id", order: Sequence[str] = DEFAULT_ORDER,
                halo_rows: int = 23, bucket_days: int = 1) -> DataFrame:
    """Attach ``_chunk`` / ``_halo`` / ``_n_key`` for skew-safe row-frame windows.

    Output = every input row once (rows without a key or a time included) with
    ``_halo=false`` and ``_chunk`` = its bucket, plus copies (``_halo=true``) of
    the last ``halo_rows`` rows that precede each bucket in the entity's order,
    tagged with that bucket.  A window ``partitionBy(key, _chunk).orderBy(order)``
    whose frame reaches at most ``halo_rows`` rows back is then exact on the
    non-halo rows.  ``_n_key`` is the entity's total row count (for size gates).

    Work outside the main shuffle: one partial count per (key, bucket), a
    top-``halo_rows`` per (key, bucket) (Spark plans it as a map-side
    WindowGroupLimit) and an equi-join on (key, block) where each bucket
    meets at most two blocks of ``halo_rows`` positions.
    """
    H = int(halo_rows)
    d = with_buckets(df, key, order, bucket_days)

    cnt = d.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    wk = Window.partitionBy(key).orderBy("_b")
    cnt = (cnt.withColumn("_cum", F.sum("_cnt").over(wk.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_n_key", F.sum("_cnt").over(Window.partitionBy(key))))
    # One row per (key, bucket): materialised once (it feeds three joins) and
    # broadcast only when its counted size allows.
    cnt, small = _bounded(cnt)
    bc = F.broadcast if small else (lambda x: x)

    if H > 0:
        wdesc = Window.partitionBy(key, "_b").orderBy(*[F.col(c).desc() for c in order])
        tails = (same(d.withColumn("_r", F.row_number().over(wdesc)).filter(F.col("_r") <= H),
                      bc(cnt.select(key, "_b", "_cum")), [key, "_b"])
                 .withColumn("_p", F.col("_cum") - F.col("_r") + 1)
                 .withColumn("_blk", F.floor((F.col("_p") - 1) / H)))
        targets = (cnt.select(key, F.col("_b").alias("_tb"),
                              (F.col("_cum") - F.col("_cnt")).alias("_e"))
                      .filter(F.col("_e") >= 1)
                      .withColumn("_s", F.greatest(F.col("_e") - H + 1, F.lit(1)))
                      .withColumn("_blk", F.explode(F.array_distinct(F.array(
                          F.floor((F.col("_s") - 1) / H), F.floor((F.col("_e") - 1) / H))))))
        halo = (same(tails, bc(targets), [key, "_blk"])
                .filter((F.col("_p") >= F.col("_s")) & (F.col("_p") <= F.col("_e")))
                .select(*df.columns, F.col("_tb").alias("_chunk"), F.lit(True).alias("_halo")))
        rows = d.select(*df.columns, F.col("_b").alias("_chunk"), F.lit(False).alias("_halo"))
        rows = rows.unionByName(halo)
    else:
        rows = d.select(*df.columns, F.col("_b").alias("_chunk"), F.lit(False).alias("_halo"))

    sizes = cnt.select(key, F.col("_b").alias("_chunk"), "_n_key")
    return same(rows, bc(sizes), [key, "_chunk"])


def series_chunks(df: DataFrame, key: str = "equipment_id", order: Sequence[str] = DEFAULT_ORDER,
                  halo_rows: int = 23) -> DataFrame:
    """``halo_chunks`` of the entities with more than ``CHUNK_ROWS`` rows; the rows of
    any other are one chunk, which is no larger than a bucket may be and needs no
    halo (a halo of 23 rows for each day copies a sparse series many times)."""
    count, small = _bounded(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n_key")).withColumn("_chunk", F.lit(0).cast("long")))
    bc = F.broadcast if small else (lambda x: x)
    rows = same(df, bc(count.where(F.col("_n_key") <= CHUNK_ROWS)), [key]).select(
        *df.columns, "_chunk", F.lit(False).alias("_halo"), "_n_key")
    hot = count.where(F.col("_n_key") > CHUNK_ROWS).select(key)
    if hot.isEmpty():
        return rows
    return rows.unionByName(halo_chunks(same(df, bc(hot), [key], "left_semi"), key, order, halo_rows))


def _bounded(df: DataFrame):
    """Materialise a small derived table; return it and whether it may be broadcast."""
    from tankwise.operators.joins import BROADCAST_MAX_ROWS, materialize_small
    m = materialize_small(df)
    return m, m.count() <= BROADCAST_MAX_ROWS


def range_halo_chunks(df: DataFrame, key: str = "equipment_id", ts: str = "ts",
                      reach_hours: int = 3, bucket_days: int = 1) -> DataFrame:
    """Chunks for time-range frames (``rangeBetween(-reach, 0)``).

    A row is copied into the next bucket as halo when it lies within
    ``reach_hours`` of that bucket's start.  Requires reach <= bucket length.
    """
    if reach_hours > 24 * bucket_days:
        raise ValueError("range reach longer than one bucket")
    b = F.floor(F.unix_date(F.to_date(F.col(ts))) / F.lit(bucket_days)).cast("long")
    # date -> TIMESTAMP_NTZ is zone-independent (midnight of the next bucket).
    start_next = F.date_from_unix_date((b + 1) * F.lit(bucket_days)).cast("timestamp_ntz")
    d = df.withColumn("_chunk", b).withColumn("_halo", F.lit(False))
    near = (df.filter(F.col(ts) >= start_next - F.make_dt_interval(F.lit(0), F.lit(reach_hours)))
              .withColumn("_chunk", b + 1).withColumn("_halo", F.lit(True)))
    return d.unionByName(near)


def chunk_window(key: str = "equipment_id", order: Sequence[str] = DEFAULT_ORDER):
    return Window.partitionBy(key, "_chunk").orderBy(*order)


def exclusive_prefix_sum(df: DataFrame, order_col: str, value_col: str, out_col: str,
                         partitions: int | None = None) -> DataFrame:
    """Running sum of ``value_col`` over rows with a smaller ``order_col``
    (exclusive), without an unpartitioned window: range-partition on the
    order, running sums inside each partition, then add each partition's
    offset from a table of one row per partition."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = df.repartitionByRange(n, order_col).withColumn("_pid", F.spark_partition_id())
    w = Window.partitionBy("_pid").orderBy(order_col)
    r = r.withColumn("_local", F.coalesce(
        F.sum(value_col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # Materialised once: both uses must see the same range boundaries.
    r = r.checkpoint(eager=True)
    tot = r.groupBy("_pid").agg(F.sum(value_col).alias("_ptot"))   # one row per partition
    tot = tot.withColumn("_poff", F.coalesce(F.sum("_ptot").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = r.join(F.broadcast(tot.select("_pid", "_poff")), "_pid")
    return out.withColumn(out_col, F.col("_poff") + F.col("_local")).drop("_pid", "_local", "_poff")


def ordered_split(df: DataFrame, frac: float = 0.8, key: str = "equipment_id",
                  order: Sequence[str] = DEFAULT_ORDER, bucket_days: int = 1) -> DataFrame:
    """WN10: flag the first floor(frac * N) rows in global (key, order) order.

    Positions come from counts: per key totals -> distributed prefix sum over
    the one-row-per-key table; per (key, bucket) running offsets within a key;
    only the single bucket that straddles the cut needs row numbers.
    """
    d = with_buckets(df, key, order, bucket_days)
    cnt, _ = _bounded(d.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_cnt")))
    per_key = cnt.groupBy(key).agg(F.sum("_cnt").alias("_kn"))
    per_key = exclusive_prefix_sum(per_key, key, "_kn", "_koff")
    total = per_key.agg(F.sum("_kn")).scalar()
    cnt = (same(cnt, per_key.select(key, "_koff"), [key])
              .withColumn("_boff", F.coalesce(F.col("_koff"), F.lit(0)) + F.coalesce(
                  F.sum("_cnt").over(Window.partitionBy(key).orderBy("_b")
                                     .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("_cut", F.floor(total * F.lit(frac)).cast("long")))
    cnt, small = _bounded(cnt)
    side = cnt.select(key, "_b", "_boff", "_cnt", "_cut")
    d = same(d, F.broadcast(side) if small else side, [key, "_b"])
    inside = F.col("_boff") + F.col("_cnt") <= F.col("_cut")
    outside = F.col("_boff") >= F.col("_cut")
    whole = d.filter(inside | outside).withColumn("is_train", inside)
    straddle = d.filter(~inside & ~outside)
    wb = Window.partitionBy(key, "_b").orderBy(*order)
    straddle = straddle.withColumn("is_train",
                                   F.col("_boff") + F.row_number().over(wb) <= F.col("_cut"))
    out = whole.unionByName(straddle)
    return out.drop("_b", "_boff", "_cnt", "_cut")


def positions(df: DataFrame, key: str = "equipment_id", order: Sequence[str] = DEFAULT_ORDER,
              per_day: bool = False) -> DataFrame:
    """``position``: each row's place (from 0) in its key's order, or in its key's day.

    Row numbers run inside buckets only; a bucket starts after the rows of all earlier
    ones of its key, known from one count a bucket."""
    d = with_buckets(df, key, order)
    count = d.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    part = [F.col(key)] + ([F.floor(F.col("_b") / PARTS)] if per_day else [])
    before = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts, small = _bounded(count.select(key, "_b", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_start")))
    d = d.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)) - 1)
    out = same(d, F.broadcast(starts) if small else starts, [key, "_b"])
    return out.withColumn("position", (F.col("_start") + F.col("_rn")).cast("long")).drop("_b", "_start", "_rn")


PAGE = 500               # entries of one nested array, at most


def paged(numbered: DataFrame, keys: Sequence[str], entry: Sequence[str], name: str, size: int = PAGE) -> DataFrame:
    """``(keys, page, name)``: the rows of ``positions`` as arrays of at most ``size``
    structs in order; a key's pages are numbered from 0 without gaps."""
    page = F.floor(F.col("position") / F.lit(size)).cast("long").alias("page")
    return numbered.groupBy(*keys, page).agg(F.sort_array(F.collect_list(F.struct("position", *entry))).alias(name))


def page_table(numbered: DataFrame, keys: Sequence[str], size: int = PAGE) -> DataFrame:
    """Entries and pages of each key, for readers that fetch page by page."""
    n = F.max("position") + 1
    return numbered.groupBy(*keys).agg(n.alias("entries"), F.ceil(n / F.lit(size)).cast("long").alias("pages"))


def top_per_group(df: DataFrame, group: str, rank_col: str, k: int,
                  dense: bool = True) -> DataFrame:
    """WN11: rows whose ``rank_col`` is among the first k per group.

    Callers pass an already distinct (group, id) table; ``row_number``/
    ``dense_rank`` with a ``<= k`` filter is planned as a map-side group limit.
    """
    w = Window.partitionBy(group).orderBy(rank_col)
    fn = F.dense_rank() if dense else F.row_number()
    return df.withColumn("_rk", fn.over(w)).filter(F.col("_rk") <= k).drop("_rk")
