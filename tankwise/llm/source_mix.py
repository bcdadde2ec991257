"""Mixing sources to target weights (operator 12), DataFrame functions only.

The words of each source are summed, the targets follow from the weights, and a
source's repetition rate is its target over its size.  Each document is taken
floor(rate) times plus once more if a seeded draw falls below the fraction: a
draw hashes the seed, the whole row and its number among equal rows, so it
depends on no partitioning and equal rows draw independently of each other.

Texts are read where they lie.  Only a digest, a size and the source of each row
are shuffled, summed up before; equal rows travel as one row with a count, so a
row that stands a third of the table is one group of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankwise.llm.shared import documents, of_ids, stored
from tankwise.operators.sequence import exclusive_prefix_sum

WEIGHTS = (5, 2, 1)          # by rank of the source, repeating
RATIO = 1.5                  # words of the mix over words of the table
CAP = 2.0                    # target of a source over its size, at most
SEED = 20250611
WORD = r"[^\x20\x09-\x0D]+"
NUMBERED = 100_000           # equal rows numbered by one task
BROADCAST_SOURCES, BROADCAST_BYTES = 100_000, 64 << 20


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(df: DataFrame) -> Column:
    """Digest of all columns of a row, nulls told apart from empty strings."""
    def plain(f):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            c = F.base64(c)
        elif not isinstance(f.dataType, T.AtomicType):
            c = F.to_json(F.struct(c.alias("v")))
        return F.coalesce(c.cast("string"), F.lit("\x1e"))
    return F.md5(F.concat_ws("\x1f", *[plain(f) for f in df.schema.fields]).cast("binary"))


def _copies(rate: Column, key: Column, number: Column, seed: int) -> Column:
    """floor(rate), plus one if the draw of this row falls below the fraction."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key, number.cast("string")).cast("binary")), 1, 13)
    draw = F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def source_targets(sizes: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: float = CAP) -> DataFrame:
    """``(source, source_size, target, rate)`` from ``(source, source_size)``, one row a source.

    Sources by code point, null last, take the weights in turn and share
    ``ratio`` of all words; a target stops at ``cap`` times its source's size and
    the excess is shared again by weight until none is above.  Each sharing is
    one aggregate over the sources; only its two sums come to the driver.  A
    source without words has target and rate 0."""
    sizes = stored(sizes, "mix_sources")
    ranked = exclusive_prefix_sum(sizes.where("source is not null").withColumn("one", F.lit(1).cast("long")),
                                  "source", "one", "rank").drop("one")
    known = sizes.where("source is not null").count()
    ranked = ranked.unionByName(sizes.where("source is null").withColumn("rank", F.lit(known).cast("long")))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.withColumn("weight", weight), "mix_ranked")

    total = int(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, above = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("source_size") * F.lit(cap)
        stopped, rest, n = ranked.agg(
            F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)),
            F.count(F.when(over, 1))).first()
        if n == above:
            break
        above = n
        level = (ratio * total - cap * int(stopped)) / int(rest) if rest else float("inf")
    share = F.lit(0.0) if total == 0 else F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(cap))
    return ranked.select("source", "source_size", share.cast("double").alias("target"),
                         F.when(F.col("source_size") > 0, share / F.col("source_size")).otherwise(0.0).alias("rate"))


def _of_source(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Each row with its source's target and rate; the sources are sent round
    only if their number and bytes are small, else both sides are shuffled and a
    hot source is split by the skew join."""
    n, size = targets.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source") + 24), F.lit(0))).first()
    key = [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_name")]
    side = targets.select(*key, "source_size", "target", "rate")
    side = F.broadcast(side) if n <= BROADCAST_SOURCES and size <= BROADCAST_BYTES else side
    return (rows.withColumn("no_source", key[0]).withColumn("source_name", key[1])
            .join(side, ["no_source", "source_name"]).drop("no_source", "source_name"))


def _numbered(groups: DataFrame) -> DataFrame:
    """One row for each of ``rows`` equal rows, with its number from 1; groups
    above ``NUMBERED`` rows are cut into pieces that are dealt over the tasks."""
    few = groups.where(F.col("rows") <= NUMBERED).withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    pieces = groups.where(F.col("rows") > NUMBERED).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {NUMBERED}"))))
    first = F.col("piece") * NUMBERED + 1
    many = pieces.repartition("key", "piece").withColumn(
        "number", F.explode(F.sequence(first, F.least(first + (NUMBERED - 1), F.col("rows"))))).drop("piece")
    return few.unionByName(many)


def mix_groups(docs: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: float = CAP) -> DataFrame:
    """``(key, doc_id, source, size, rows, source_size, target, rate)``: one row for
    each group of equal rows of ``docs``, stored."""
    narrow = docs.select(row_key(docs).alias("key"), "doc_id", "source", words_in(F.col("text")).alias("size"))
    groups = stored(narrow.groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("rows")), "mix_groups")
    sizes = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).cast("long").alias("source_size"))
    return _of_source(groups, source_targets(sizes, weights, ratio, cap))


def mix_plan(docs: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """``(key, doc_id, source, size, source_size, target, copies)``: one row for each
    row of ``docs(doc_id, text, source)``; ``copies`` is how often the mix takes it.

    Null or empty texts have size 0; a null source is a source of its own, the
    last; null ids and repeated rows are rows like any other, each with its own
    draw; very long texts are counted whole; other columns, whatever their names,
    only enter the digest; an empty table gives an empty result.  Sources of
    equal size differ by rank only."""
    rows = _numbered(mix_groups(docs, weights, ratio, cap))
    copies = _copies(F.col("rate"), F.col("key"), F.col("number"), seed)
    return rows.select("key", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """``(record, copy)``: the mix itself, each document's row as a struct as often as
    ``mix_plan`` takes it.

    Rows that stand once are emitted where they are read; only rows that stand
    several times are shuffled, merged map-side, and emitted by the sum of their
    copies."""
    groups = stored(mix_groups(docs, weights, ratio, cap), "mix_rates")
    several = groups.where("rows > 1")
    times = (_numbered(several).select("key", _copies(F.col("rate"), F.col("key"), F.col("number"), seed).alias("copies"))
             .groupBy("key").agg(F.sum("copies").cast("long").alias("copies")))
    records = docs.select(row_key(docs).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"))
    keys = stored(several.select("key").distinct(), "mix_several")
    rates = groups.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"),
                                         F.first("rate").alias("rate"))
    once = _of_source(of_ids(records, keys, "left_anti", "key").withColumn("source", F.col("record.source")), rates)
    once = once.select("key", "record", _copies(F.col("rate"), F.col("key"), F.lit(1), seed).cast("long").alias("rows"))
    equal = (of_ids(records, keys, "left_semi", "key").groupBy("key").agg(F.first("record").alias("record"))
             .join(times, "key").select("key", "record", F.col("copies").alias("rows")))
    return _numbered(once.unionByName(equal).where("rows > 0")).select("record", F.col("number").alias("copy"))


def op12_source_mix(spark, sf_dir):
    """All documents mixed to weights 5, 2, 1 and 150 % of their words."""
    plan = mix_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         md5(concat_ws(chr(31), coalesce(doc_id::VARCHAR, chr(30)), coalesce(text, chr(30)), coalesce(lang, chr(30)),
                       coalesce(source, chr(30)), coalesce(n_chars::VARCHAR, chr(30)))) AS key
  FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY key, doc_id, source, size) AS number FROM d),
weighted AS (
  SELECT source, source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
ordered AS (
  SELECT *, 2e0 * source_size / weight AS stop, row_number() OVER o AS place,
         coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stopped,
         sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         (sum(source_size) OVER ())::BIGINT AS total
  FROM weighted WINDOW o AS (ORDER BY 2e0 * source_size / weight, source NULLS LAST)),
level AS (
  SELECT (1.5e0 * total - 2e0 * stopped) / rest::DOUBLE AS level FROM ordered
  WHERE (1.5e0 * total - 2e0 * stopped) / rest::DOUBLE <= stop ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size, least(weight * level, source_size * 2e0) AS target,
         CASE WHEN source_size > 0 THEN least(weight * level, source_size * 2e0) / source_size ELSE 0e0 END AS rate
  FROM weighted, level)
SELECT n.doc_id, n.size, t.source_size, t.target,
       (n.size * (floor(t.rate) + CASE WHEN
          ('0x' || substr(md5(concat_ws('|', '{SEED}', n.key, n.number::VARCHAR)), 1, 13))::BIGINT / 4503599627370496e0
          < t.rate - floor(t.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM numbered n JOIN targets t ON n.source IS NOT DISTINCT FROM t.source
"""
