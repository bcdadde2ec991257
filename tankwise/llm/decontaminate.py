"""Benchmark decontamination (operator 9), DataFrame functions only.

Every benchmark item is sought in every document with windows of the item's own
word count.

1. *Windows.*  A window can only be similar to an item if it holds one of its
   5-word shingles, so the windows of a document are those that put a shared
   shingle where the item has it (an insertion or deletion inside the passage
   gives one window for each side of it).
2. *SimHash.*  A window's 64-bit fingerprint is the sign of the weighted vote of
   its shingles; weights fall with the number of items that hold a shingle, and a
   shingle of no item weighs what the window's other shingles do on average.
3. *Multi-index.*  Fingerprints are cut into 8 blocks.  Within Hamming radius R
   some block differs in at most R // 8 bits; items are indexed under all values
   of each block within that distance, so the join on (words, block, value)
   finds every item within the radius.
4. *Rare shingles.*  A fingerprint is no proof, so pairs outside the radius are
   sought too: the rarest shingles of an item that together weigh more than 0.25
   of it cannot all be missing, so a join on them finds every pair that counts.
5. *Exact check.*  A found pair counts if the item's shingles inside the window
   weigh at least 0.75 of all its shingles.

Items of fewer than five words have their whole sequence as one shingle.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tankwise.llm.shared import documents, let, of_ids, stored

K = 5
SIMILARITY = 0.75
RADIUS = 27
BLOCKS = 8
BROADCAST_ROWS = 400_000   # shingles of the benchmark up to which its index is broadcast (16 bytes each)


def words_of(text) -> F.Column:
    return F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingles_of(words, k: int) -> F.Column:
    """Hash of the k words from each place of ``words``; empty if there are fewer."""
    return let(words, lambda ws: F.when(F.size(ws) >= k, F.transform(
        F.sequence(F.lit(0), F.size(ws) - k), lambda i: F.xxhash64(F.lit(k), *[F.get(ws, i + j) for j in range(k)]))
    ).otherwise(F.array().cast("array<bigint>")))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _fingerprint(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash per key of ``shingles(keys, h, weight)``, as 8 byte-sized blocks."""
    bit = [F.sum(F.when(F.col("h").bitwiseAND(F.lit(1 << b if b < 63 else -(1 << 63))) != 0, F.col("weight"))
                 .otherwise(-F.col("weight"))).alias(f"b{b}") for b in range(64)]
    votes = shingles.groupBy(*keys).agg(*bit)
    blocks = []
    for k in range(BLOCKS):
        value = F.lit(0)
        for j in range(8):
            value = value + F.when(F.col(f"b{8 * k + j}") > 0, 1 << j).otherwise(0)
        blocks.append(value)
    return votes.select(*keys, F.array(*blocks).alias("blocks"))


def _rarest(whole: DataFrame, similarity: float) -> DataFrame:
    """Shingles of each item, rarest first, until they weigh more than it may miss
    (a hair more, for sums in another order)."""
    item = Window.partitionBy("item", "version", "n")
    before = F.sum("weight").over(item.orderBy(F.desc("weight"), "h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight")
    return (whole.withColumns({"before": before, "most": F.sum("weight").over(item) * (1 - similarity + 1e-6)})
            .where("before <= most").select("item", "version", "n", "h"))


def _apart(a: str, b: str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY,
                  radius: int = RADIUS) -> DataFrame:
    """``(id, item, first_word, n_words, similarity)``: each item found in each
    document, with its best window (the first of equals).

    Null, empty and wordless texts and items match nothing; repeated rows of a
    document or an item give one result; null ids are not reported; documents
    without a match give no row.  Other columns are not read."""
    items = (benchmark.select(F.col(item_col).alias("item"), words_of(F.col(item_text).cast("string")).alias("words"))
             .where("item is not null and size(words) > 0").dropDuplicates(["item", "words"])
             .withColumn("n", F.size("words")))
    sizes = [r[0] for r in items.select(F.least("n", F.lit(K))).distinct().collect()]     # at most K values
    parts = [items.where(F.least("n", F.lit(K)) == k).select(
        "item", "n", F.hash("words").alias("version"), F.posexplode(shingles_of(F.col("words"), k)).alias("at", "h"))
        for k in sizes]
    if not parts:
        return docs.select(F.col(id_col).alias(id_col)).limit(0).select(
            id_col, F.lit(None).cast("long").alias(item_col), F.lit(0).alias("first_word"), F.lit(0).alias("n_words"),
            F.lit(0.0).alias("similarity"))
    index = parts[0]
    for p in parts[1:]:
        index = index.unionAll(p)
    index = stored(index, "items")
    rows = index.count()
    weight = index.groupBy("h").agg((1 / (1 + F.log(F.countDistinct("item", "version").cast("double")))).alias("weight"))
    weight = stored(weight, "weights")
    whole = index.select("item", "version", "n", "h").distinct().join(_bounded(weight, rows), "h")
    total = whole.groupBy("item", "version", "n").agg(F.sum("weight").alias("total"))

    texts = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col).cast("string")).alias("words"))
    places = None
    for k in sizes:
        hs = shingles_of(F.col("words"), k)
        found = (texts.where("id is not null").select("id", hs.alias("hs"))
                 .select("id", (F.size("hs") + k - 1).alias("size"), F.posexplode("hs").alias("pos", "h"))
                 .join(_bounded(index.where(F.least("n", F.lit(K)) == k).select("h", "n", "at"), rows), "h")
                 .select("id", "n", F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.col("size") - F.col("n")))
                         .alias("start")))
        places = found if places is None else places.unionAll(found)
    windows = stored(places.distinct(), "windows")

    # only texts with a window are shuffled (not their words), each once
    wanted = windows.groupBy("id").agg(F.collect_list(F.struct("n", "start")).alias("w"))
    ids = stored(windows.select("id").distinct(), "ids")
    whole_texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    cut = (of_ids(whole_texts, ids, "left_semi", "id").join(wanted, "id")
           .select("id", words_of(F.col("text")).alias("words"), "w").select("id", "words", F.explode("w").alias("w"))
           .select("id", "w.n", "w.start", F.slice("words", F.col("w.start") + 1, F.col("w.n")).alias("part")))
    spans = None
    for k in sizes:
        s = (cut.where(F.least("n", F.lit(K)) == k)
             .select("id", "n", "start", F.explode(shingles_of(F.col("part"), k)).alias("h")))
        spans = s if spans is None else spans.unionAll(s)
    # a window holds a shingle of an item, so its mean is never null
    mean = F.avg("weight").over(Window.partitionBy("id", "n", "start"))
    spans = stored(spans.distinct().join(_bounded(weight, rows), "h", "left")
                   .select("id", "n", "start", "h", F.coalesce("weight", mean).alias("weight")), "spans")

    prints = _fingerprint(spans, ["id", "n", "start"])
    marks = _fingerprint(whole, ["item", "version", "n"])
    near = [sum(1 << j for j in c) for r in range(radius // BLOCKS + 1) for c in combinations(range(8), r)]
    keyed = marks.select("item", "version", "n", F.col("blocks").alias("mark"), F.posexplode("blocks").alias("block", "value")).select(
        "item", "version", "n", "mark", "block", F.explode(F.transform(F.array(*[F.lit(x) for x in near]),
                                                                       lambda x: x.bitwiseXOR(F.col("value")))).alias("value"))
    probes = prints.select("id", "n", "start", F.col("blocks").alias("print"), F.posexplode("blocks").alias("block", "value"))
    rare = spans.join(_bounded(_rarest(whole, similarity), rows), ["n", "h"])
    pairs = (probes.join(keyed, ["n", "block", "value"]).where(_apart("print", "mark") <= radius)
             .select("id", "start", "item", "version", "n")
             .unionAll(rare.select("id", "start", "item", "version", "n")).distinct())

    shared = (pairs.join(spans.select("id", "n", "start", "h"), ["id", "n", "start"])
              .join(_bounded(whole.select("item", "version", "n", "h", "weight"), rows), ["item", "version", "n", "h"])
              .groupBy("id", "item", "version", "n", "start").agg(F.sum("weight").alias("common")))
    best = F.max_by(F.struct("start", "n", "sim"), F.struct("sim", -F.col("start"), -F.col("n"))).alias("best")
    return (shared.join(_bounded(total, rows), ["item", "version", "n"])
            .withColumn("sim", F.least(F.lit(1.0), F.round(F.col("common") / F.col("total"), 9)))
            .where(F.col("sim") >= similarity).groupBy("id", "item").agg(best)
            .select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("best.start").alias("first_word"),
                    F.col("best.n").alias("n_words"), F.col("best.sim").alias("similarity")))


def op9_decontaminate(spark, sf_dir):
    """Benchmark items inside documents."""
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
