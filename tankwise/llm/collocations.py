"""Phrase collocation mining (operator 13): an FM-index a shard, summed over shards.

Each task cuts its texts into shards of one language and about ``SHARD`` words and
stores each as a bidirectional FM-index over the shard's own word ids, with its
dictionary and word counts.  Texts are read once; everything else comes from the
indexes:

* Word totals: dictionaries summed over shards.
* For 2, 3 and 4 words in turn every shard extends its intervals by one word (left,
  right, left) and gives each n-gram's hash with its count; summed over
  shards these are upper bounds, exact but for hash collisions.  Only what can
  reach the least count is extended: a phrase as frequent as that has no rarer part.
* The hashes that reach it are sent round as a bitmap of at most ``MAX_BITS`` bits
  (a fuller bitmap lets more through, never less).  A last pass gives the n-grams
  it lets through as text, and their sums over shards are exact.
* Scores, cuts and the best left and right extensions come from joins of these
  totals, in decimal arithmetic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tankwise.llm.fm_index import Grams, Index, bwt, text_of
from tankwise.llm.shared import arrow_map, documents, dropped, stored
from tankwise.llm.words import U, mix, text_chunks, word_hashes
from tankwise.session import scratch_path, settings

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
NO_LANG = "und"
INSIDE = 80                  # a candidate goes if a longer one has this many percent of its count
SHARD = 1 << 18              # words of a shard, about (one text is never cut)
BATCH = "16m"                # bytes that a task takes at once, of indexes and of shuffled counts
MAX_BITS = 1 << 28           # bitmap of frequent n-grams of one length: 32 MB
BITS_EACH = 32
HASH = U((1 << 48) - 1)      # what of a hash is sent: 48 bits hold the n-grams of 100 TB apart but for some percent

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUT = np.zeros(256, bool)
_CUT[list(b".,;:!?\n\x0b\x0c\r")] = True
_SOLID = ~_CUT
_SOLID[[0x20, 0x09]] = False


# ------------------------------------------------------------------- shards
def _words(offsets: np.ndarray, data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of a chunk of texts in order, and which of them open a piece."""
    n = len(data)
    solid = _SOLID[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return pa.array([], pa.large_string()), np.zeros(0, bool)
    cuts = np.cumsum(_CUT[data] | (first & edge[:n])) + np.cumsum(edge[:n])
    opens = np.ones(len(starts), bool)
    opens[1:] = cuts[starts[1:]] != cuts[starts[:-1]]
    before = np.zeros(n + 1, np.int64)
    np.cumsum(solid, out=before[1:])
    ends = np.append(before[starts], before[n])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends.tobytes()),
                                                                   pa.py_buffer(_LOWER[data[solid]].tobytes())])
    return words, opens


INDEX = "lang string, words array<string>, counts array<long>, length int, left binary, right binary"
_INDEX_NAMES = ["lang", "words", "counts", "length", "left", "right"]


def _shard(lang: str, words: list[pa.Array], opens: list[np.ndarray], depth: int) -> pa.RecordBatch:
    coded = pa.concat_arrays(words).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1
    text = text_of(ids, np.concatenate(opens))
    counts = np.bincount(ids, minlength=len(coded.dictionary) + 1)[1:]
    one = np.array([0, len(counts)], np.int32)
    return pa.RecordBatch.from_arrays([
        pa.array([lang]), pa.ListArray.from_arrays(one, coded.dictionary.cast(pa.string())),
        pa.ListArray.from_arrays(one, pa.array(counts.astype(np.int64))),
        pa.array([len(text)], pa.int32()), *(pa.array([pa.compress(bwt(t, depth).tobytes(), "zstd", asbytes=True)], pa.binary())
                                             for t in (text, text[::-1]))],
        names=_INDEX_NAMES)


def build_index(docs: DataFrame, max_words: int = MAX_WORDS, shard: int = SHARD) -> DataFrame:
    """One row a shard: language, dictionary, counts and both BWTs, stored."""
    def run(batches):
        held: dict[str, list] = {}
        size: dict[str, int] = {}

        def close(lang):
            words, opens = held.pop(lang), size.pop(lang)
            if opens:
                return [_shard(lang, [w for w, _ in words], [o for _, o in words], max_words)]
            return []
        for b in batches:
            langs, texts = b.column("lang"), b.column("text")
            for lang in pc.unique(langs).to_pylist():
                for _, off, data in text_chunks(texts.filter(pc.equal(langs, lang))):
                    words, opens = _words(off, data)
                    held.setdefault(lang, []).append((words, opens))
                    size[lang] = size.get(lang, 0) + len(words)
                    if size[lang] >= shard:
                        yield from close(lang)
                    elif sum(size.values()) >= 2 * shard:          # many languages at once
                        yield from close(max(size, key=size.get))
        for lang in sorted(held):
            yield from close(lang)
    rows = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    index = arrow_map(rows, run, INDEX)
    path = scratch_path(docs.sparkSession, "phrase_index")
    # few shards a row group, so that a reader holds few of them at a time
    (index.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).option("parquet.block.size.row.check.min", 1)
     .option("parquet.block.size.row.check.max", 1).parquet(path))
    out = docs.sparkSession.read.schema(index.schema).parquet(path)
    out._stored_at = path
    return out


# -------------------------------------------------------------- enumeration
def _hashes(strings: pa.Array, salt: int) -> np.ndarray:
    """64-bit hash of each string."""
    strings = strings.cast(pa.large_string())
    off = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[off[0]:off[-1]]
    off = off - off[0]
    return mix(word_hashes(data, off[:-1], off[1:]), salt)


def _gram_hashes(word: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Hash of each row of ids, from the hashes of the words in order."""
    out = np.zeros(len(grams), U)
    with np.errstate(over="ignore"):
        for k in range(grams.shape[1]):
            out = mix(out + word[grams[:, k]], k + 1)
    return out & HASH


def _let_through(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & U(len(bitmap) * 8 - 1)
    return (bitmap[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1


def _levels(batch_row, bitmaps: list[np.ndarray], longest: int):
    """Yield the n-grams of 2 to ``longest`` words of one shard with their hashes, as
    far as ``bitmaps`` (for 1 word, 2 words, ...) let their parts through; lengths
    that have a bitmap themselves are cut down by it."""
    lang, words, left, right = batch_row
    word = np.concatenate([np.zeros(1, U), _hashes(words, int(_hashes(pa.array([lang + "."]), 0)[0] & U(0xFFFFFFFF)))])
    wanted = _let_through(bitmaps[0], _gram_hashes(word, np.arange(len(word))[:, None]))
    wanted[0] = False
    index = Index(left, right, len(word))
    grams: Grams = index.unigrams(wanted)
    for size in range(2, longest + 1):
        side = "left" if size % 2 == 0 else "right"
        grams = index.extend(grams, side, wanted)
        if size > 2:                    # the other part that is one word shorter
            other = grams.words[:, :-1] if side == "left" else grams.words[:, 1:]
            grams = grams.where(_let_through(bitmaps[size - 2], _gram_hashes(word, other)))
        hashes = _gram_hashes(word, grams.words)
        if size <= len(bitmaps):
            keep = _let_through(bitmaps[size - 1], hashes)
            grams, hashes = grams.where(keep), hashes[keep]
        yield size, grams, hashes


def _shards(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield (b.column("lang")[i].as_py(), b.column("words")[i].values,
                   *(np.frombuffer(pa.decompress(b.column(c)[i].as_buffer(), 4 * b.column("length")[i].as_py(), "zstd"), np.int32)
                     for c in ("left", "right")))


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """Bits at the hashes of ``frequent(h)``, at most ``MAX_BITS`` of them; the
    driver gets the words of 64 bits that are not empty."""
    n = frequent.count()
    bits = 1 << 10
    while bits < min(MAX_BITS, BITS_EACH * n):
        bits <<= 1
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    filled = (frequent.select(F.shiftright(place, 6).cast("int").alias("at"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
              .groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow())
    out = np.zeros(bits // 64, np.int64)
    out[filled["at"].to_numpy()] = filled["bits"].to_numpy()
    return out.view(np.uint8)


def _frequent_hashes(index: DataFrame, sent, size: int, min_count: int) -> DataFrame:
    """``(h)``: hashes of n-grams of ``size`` words whose sum over shards reaches the
    least count, stored."""
    def run(batches):
        for row in _shards(batches):
            for k, grams, hashes in _levels(row, sent.value, size):
                if k == size and len(hashes):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(grams.count)], names=["h", "c"])
    # a shard's counts are sums already: no second table of them before the shuffle
    counted = arrow_map(index.drop("counts"), run, "h long, c long").repartition("h")
    return stored(counted.groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= min_count).select("h"), "frequent")


def _texts(index: DataFrame, sent, max_words: int) -> DataFrame:
    """``(lang, phrase, size, c)`` of each shard's n-grams that the bitmaps let through."""
    names = ["lang", "phrase", "size", "c"]

    def run(batches):
        for row in _shards(batches):
            for size, grams, hashes in _levels(row, sent.value, max_words):
                m = len(hashes)
                if m:
                    parts = [row[1].take(pa.array(grams.words[:, k] - 1)) for k in range(size)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row[0]]).take(pa.array(np.zeros(m, np.int32))), pc.binary_join_element_wise(*parts, " "),
                        pa.array(np.full(m, size, np.int32)), pa.array(grams.count)], names=names)
    return arrow_map(index.drop("counts"), run, "lang string, phrase string, size int, c long")


def _word_rows(index: DataFrame) -> DataFrame:
    return (index.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
            .select("lang", F.col("w.words").alias("phrase"), F.col("w.counts").alias("c")))


def _word_hashes(words: DataFrame) -> DataFrame:
    """``(h)`` of each ``(lang, phrase)`` of one word, as ``_levels`` hashes it."""
    def run(batches):
        for b in batches:
            langs, phrases = b.column("lang"), b.column("phrase")
            for lang in pc.unique(langs).to_pylist():
                salt = int(_hashes(pa.array([lang + "."]), 0)[0] & U(0xFFFFFFFF))
                word = _hashes(phrases.filter(pc.equal(langs, lang)), salt)
                yield pa.RecordBatch.from_arrays([pa.array(_gram_hashes(word, np.arange(len(word))[:, None]).view(np.int64))], names=["h"])
    return arrow_map(words.select("lang", "phrase"), run, "h long")


# ------------------------------------------------------------------ results
def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                  shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, size, f)`` of all phrases of 1 to ``max_words`` words that occur
    at least ``min_count`` times in their language, and ``(lang, n)``, both stored."""
    spark = docs.sparkSession
    with settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH, "spark.sql.adaptive.advisoryPartitionSizeInBytes": BATCH}):
        return _phrase_counts(spark, build_index(docs, max_words, shard), min_count, max_words)


def _phrase_counts(spark: SparkSession, index: DataFrame, min_count: int, max_words: int) -> tuple[DataFrame, DataFrame]:
    words = stored(_word_rows(index).groupBy("lang", "phrase").agg(F.sum("c").alias("f")), "words")
    totals = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    frequent = stored(words.where(F.col("f") >= min_count).select("lang", "phrase", F.lit(1).alias("size"), "f"), "words_kept")
    dropped(words)
    bitmaps = [_bitmap(_word_hashes(frequent))]
    for size in range(2, max_words + 1):
        sent = spark.sparkContext.broadcast(bitmaps)
        hashes = _frequent_hashes(index, sent, size, min_count)
        bitmaps = [*bitmaps, _bitmap(hashes)]
        dropped(hashes)
        sent.unpersist()
    sent = spark.sparkContext.broadcast(bitmaps)
    longer = (_texts(index, sent, max_words).groupBy("lang", "phrase", "size").agg(F.sum("c").alias("f"))
              .where(F.col("f") >= min_count))
    out = stored(frequent.unionByName(longer), "phrases")
    dropped(index, frequent)
    return out, totals


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, shard: int = SHARD) -> DataFrame:
    """``(lang, phrase, size, a, l, r, n, score, left_best, right_best)``: each phrase of 2
    words and more in ``docs(lang, text)`` that occurs ``min_count`` times in its
    language, with its weakest cut and the counts of its most frequent extensions by
    one word to the left and to the right (null if none is that frequent).

    A null text is empty, a null lang is ``und``, equal to that name; texts without
    words give nothing, repeated rows count each, very long texts are taken whole (a
    shard holds one at least); ties of cuts go to the shorter first part; columns
    beside lang and text are not read; an empty table gives an empty result."""
    counts, totals = phrase_counts(docs, min_count, max_words, shard)
    long = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    parts = F.split("phrase", " ")
    cuts = (long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
            .withColumn("head", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " "))
            .withColumn("tail", F.array_join(F.slice(parts, F.col("k") + 1, F.col("size") - F.col("k")), " ")))
    f = counts.select("lang", "phrase", "f")
    cuts = (cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
            .join(f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]))
    score = F.expr("(cast(2000000 as decimal(8,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    weakest = (cuts.select("lang", "phrase", F.struct(score.alias("score"), "k", "l", "r").alias("cut"), "a", "size")
               .groupBy("lang", "phrase", "size", "a").agg(F.min("cut").alias("cut")))
    wide = long.where("size > 2")
    right = (wide.groupBy("lang", F.array_join(F.slice(parts, F.lit(1), F.col("size") - 1), " ").alias("phrase"))
             .agg(F.max("a").alias("right_best")))
    left = (wide.groupBy("lang", F.array_join(F.slice(parts, F.lit(2), F.col("size") - 1), " ").alias("phrase"))
            .agg(F.max("a").alias("left_best")))
    return (weakest.join(left, ["lang", "phrase"], "left").join(right, ["lang", "phrase"], "left").join(totals, "lang")
            .select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score", "left_best", "right_best"))


def best_phrases(found: DataFrame, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """Each language's first ``top`` collocations that stand for themselves: none that
    lies in a longer one with ``inside`` percent of its count.  A longer phrase by two
    words has one in between that is as frequent at least, so one word more is enough
    to look at."""
    best = F.greatest("left_best", "right_best").cast("decimal(19,0)")
    alone = found.where(best.isNull() | (best * 100 < F.col("a").cast("decimal(19,0)") * F.lit(inside)))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (alone.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def op13_collocations(spark, sf_dir):
    """The first 2000 collocations of each language of ``documents``."""
    return best_phrases(collocations(documents(spark, sf_dir)))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS MATERIALIZED (
  SELECT * FROM (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces) WHERE len(w) > 0),
o AS MATERIALIZED (SELECT lang, p, unnest(w) AS x1, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT lang, x1, lead(x1) OVER q AS x2, lead(x1, 2) OVER q AS x3, lead(x1, 3) OVER q AS x4 FROM o WINDOW q AS (PARTITION BY p ORDER BY i)),
f AS MATERIALIZED (
  SELECT lang, x1 AS phrase, 1 AS size, count(*) AS f FROM o GROUP BY ALL
  UNION ALL SELECT lang, concat_ws(' ', x1, x2), 2, count(*) FROM g WHERE x2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, concat_ws(' ', x1, x2, x3), 3, count(*) FROM g WHERE x3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, concat_ws(' ', x1, x2, x3, x4), 4, count(*) FROM g WHERE x4 IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, string_split(phrase, ' ') AS w, size, f AS a FROM f WHERE size > 1 AND f >= 30),
parts AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r, (2000000::HUGEINT * c.a // (h.f + t.f))::BIGINT AS score
  FROM parts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, size - s + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS s FROM c))
  GROUP BY ALL),
kept AS (
  SELECT x.* FROM weakest x LEFT JOIN inner_parts p ON x.lang = p.lang AND x.phrase = p.phrase
  WHERE p.longer IS NULL OR 100::HUGEINT * p.longer < 80::HUGEINT * x.a)
SELECT * FROM (
  SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM kept k JOIN totals USING (lang)) WHERE rank <= 2000
"""
