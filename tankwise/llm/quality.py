"""Quality classifier (operator 6): weak labels and a hashed linear scorer.

No gold label is read.  Overlapping heuristic labellers each vote for one class
or abstain on every document.  Expectation-maximisation on the table of vote
patterns (at most 2^13 rows whatever the corpus) estimates each labeller's
accuracy, the probability that its class is right where it votes, and a
posterior for every pattern.  Posterior labels of a bounded sample of documents
train a logistic scorer on hashed word shapes, which decides about all
documents.

Bounds: about SAMPLE documents (those with the lowest hashes) train the scorer;
votes, patterns and scores cover all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankwise.llm.shared import arrow_map, documents
from tankwise.llm.words import text_chunks, word_bounds, word_hashes

SAMPLE = 20_000
HASH_BITS = 11
THRESHOLD = 0.5
GOOD, BAD = 1, 0
# labeller, the class it votes for, accuracy that EM starts from
LABELLERS = (("symbols", BAD, 0.85), ("symbol_words", BAD, 0.85), ("bars", BAD, 0.85), ("bare_words", BAD, 0.85),
             ("capitals", BAD, 0.85), ("exclamations", BAD, 0.85), ("few_distinct", BAD, 0.85),
             ("top_word", BAD, 0.85), ("repeats", BAD, 0.85), ("long_words", BAD, 0.85),
             ("prose", GOOD, 0.7), ("varied", GOOD, 0.7), ("sentences", GOOD, 0.7))

# byte classes
_KIND = np.zeros(256, np.uint16)
_UPPER, _LOWER, _DIGIT, _SYMBOL, _BAR, _EXCLAIM, _STOP, _COMMA, _HIGH, _OTHER = (1 << i for i in range(10))
_KIND[:] = _OTHER
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
for _c in b"#$%&*~^=<>{}\\@+_":
    _KIND[_c] = _SYMBOL
_KIND[ord("|")], _KIND[ord("!")] = _BAR, _EXCLAIM
for _c in b".?":
    _KIND[_c] = _STOP
for _c in b",;:":
    _KIND[_c] = _COMMA
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0


def _per(flag, off):
    c = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=c[1:])
    return (c[off[1:]] - c[off[:-1]]).astype(float)


def _measures(off, data):
    """Per text: word count and the quantities that labellers judge; per word:
    shape code and text index."""
    starts, ends, first = word_bounds(off, data)
    m, n = len(off) - 1, np.diff(first).astype(float)
    kind = _KIND[data]
    size = np.maximum(np.diff(off).astype(float), 1)
    solid = np.maximum(_per(kind > 0, off), 1)
    letters = _per((kind & (_UPPER | _LOWER | _HIGH)) > 0, off)
    doc = np.repeat(np.arange(m), np.diff(first))
    h = word_hashes(data, starts, ends)
    one = np.maximum(n, 1)
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    head = np.ones(len(hs), bool)
    head[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    at = np.flatnonzero(head)
    runs = np.diff(np.append(at, len(hs)))
    top = np.zeros(m)
    np.maximum.at(top, ds[at], runs)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    flags = np.bitwise_or.reduceat(kind, starts) if len(starts) else np.zeros(0, np.uint16)
    if len(starts):
        # reduceat runs on to the next start: white space between words adds nothing
        length = ends - starts
        shape = flags.astype(np.int64) | (np.minimum(np.log2(length).astype(np.int64), 6) << 10)
    else:
        shape = np.zeros(0, np.int64)
    lettered = (flags & (_UPPER | _LOWER | _HIGH)) > 0
    marked = (flags & _SYMBOL) > 0
    q = {
        "symbols": _per(kind == _SYMBOL, off) / solid,
        "bars": _per(kind == _BAR, off) / one,
        "capitals": _per(kind == _UPPER, off) / np.maximum(letters, 1),
        "distinct_words": np.bincount(ds[at], minlength=m) / one,
        "top_word": top / one,
        "repeats": np.bincount(doc[again], minlength=m) / one,
        "exclamations": _per(kind == _EXCLAIM, off) / one,
        "letters": letters / solid,
        "word_length": solid / one,
        "bare_words": np.bincount(doc[~lettered], minlength=m) / one,
        "symbol_words": np.bincount(doc[lettered & marked], minlength=m) / one,
        "stops": _per(kind == _STOP, off) / one,
    }
    return n, q, shape, doc, size


def _votes(n, q):
    """(documents, labellers): whether each labeller votes."""
    long = n >= 20
    plain = (q["symbols"] < 0.04) & (q["capitals"] < 0.3) & (q["letters"] > 0.5) & (n > 0)
    return np.stack([
        q["symbols"] > 0.06,
        q["symbol_words"] > 0.3,
        q["bars"] > 0.2,
        q["bare_words"] > 0.2,
        (q["capitals"] > 0.4) & (n >= 5),
        q["exclamations"] > 0.5,
        (q["distinct_words"] < 0.25) & long,
        (q["top_word"] > 0.25) & long,
        (q["repeats"] > 0.25) & (n >= 5),
        q["word_length"] > 18,
        plain & (q["bare_words"] < 0.15) | plain & ~long,
        (q["distinct_words"] > 0.4) & (((q["repeats"] < 0.1) & (q["top_word"] < 0.2)) | ~long) & (q["exclamations"] < 0.2),
        plain & (q["repeats"] < 0.1) & ((q["stops"] > 0.01) & (q["stops"] < 0.5) | ~long),
    ], axis=1)


def pattern_codes(votes: np.ndarray) -> np.ndarray:
    return votes.astype(np.int64) @ (1 << np.arange(votes.shape[1]))


def _pattern_rows(batches):
    for batch in batches:
        for row, off, data in text_chunks(batch.column(0)):
            n, q, _, _, _ = _measures(off, data)
            code = pattern_codes(_votes(n, q))
            code[n == 0] = -1
            v, c = np.unique(code, return_counts=True)
            yield pa.record_batch([pa.array(v), pa.array(c)], names=["code", "n"])


def estimate(codes: np.ndarray, counts: np.ndarray, labellers=LABELLERS, rounds: int = 200):
    """EM for two classes: ``(share of good, rate at which each labeller votes by
    class, posterior of good per pattern)``.  Labellers vote independently given
    the class.  The first posterior weighs votes by the starting accuracies, so
    that class 1 is "good"; a labeller's estimated accuracy follows from its rates
    and the class share by Bayes' rule."""
    voted = ((codes[:, None] >> np.arange(len(labellers))) & 1).astype(float)
    sign = np.array([1 if c == GOOD else -1 for _, c, _ in labellers])
    start = np.array([a for _, _, a in labellers])
    w, prior = counts.astype(float), 0.8
    odds = voted @ (sign * np.log(start / (1 - start))) + np.log(prior / (1 - prior))
    post, rate = 1 / (1 + np.exp(-odds)), None
    for _ in range(rounds):
        prior = float(np.clip((w * post).sum() / w.sum(), 0.02, 0.98))
        rate = np.stack([((w * r) @ voted + 0.5) / ((w * r).sum() + 1) for r in (1 - post, post)])
        rate = np.clip(rate, 1e-4, 1 - 1e-4)
        like = [voted @ np.log(r) + (1 - voted) @ np.log(1 - r) for r in rate]
        new = 1 / (1 + np.exp(-np.clip(like[GOOD] - like[BAD] + np.log(prior / (1 - prior)), -700, 700)))
        moved = np.abs(new - post).max()
        post = new
        if moved < 1e-9:
            break
    return prior, rate, post


def _features(n, q, shape, doc, bits):
    """Hashed features as (row, column, value): word shapes by share of words, and
    steps of the measured quantities."""
    m, size = len(n), 1 << bits
    col = (shape * 0x9E3779B1 >> 7) % (size - 256)
    key, count = np.unique(doc * size + col, return_counts=True)
    r, c = key // size, key % size
    parts = [(r, c, np.sqrt(count / n[r]))]
    for i, name in enumerate(sorted(q)):
        x = q[name]
        step = np.minimum((8 * x / (x + (6 if name == "word_length" else 0.2))).astype(int), 7)
        parts.append((np.arange(m), size - 256 + i * 8 + step, np.ones(m)))
    return tuple(np.concatenate(z) for z in zip(*parts))


def _sample_rows(batches, posterior, bits):
    for batch in batches:
        for row, off, data in text_chunks(batch.column(0)):
            n, q, shape, doc, _ = _measures(off, data)
            code = pattern_codes(_votes(n, q))
            r, c, v = _features(n, q, shape, doc, bits)
            order = np.argsort(r, kind="stable")
            cut = np.searchsorted(r[order], np.arange(len(n) + 1))
            p = [float(posterior.value.get(int(x), 0.5)) for x in code]
            yield pa.record_batch([pa.array(p), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(c[order].astype(np.int32))),
                                   pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(v[order]))],
                                  names=["p", "cols", "vals"])


def fit_scorer(p, cols, vals, bits: int, rounds: int = 300, rate: float = 1.0, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights (bias last) by full-batch AdaGrad on soft labels, classes
    balanced."""
    size = 1 << bits
    row = np.repeat(np.arange(len(p)), [len(c) for c in cols])
    col, val = np.concatenate(cols), np.concatenate(vals)
    good = max(p.sum(), 1e-9)
    weight = np.where(p > 0.5, 0.5 / good, 0.5 / max((1 - p).sum(), 1e-9))
    weight /= weight.sum()
    w, seen = np.zeros(size + 1), np.full(size + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, w[col] * val, minlength=len(p)) + w[-1]
        g = weight * (1 / (1 + np.exp(-z)) - p)
        grad = np.append(np.bincount(col, g[row] * val, minlength=size), g.sum()) + decay * w
        seen += grad * grad
        w -= rate * 0.3 * grad / np.sqrt(seen)
    return w


def _judge(column: pa.Array, posterior: dict, weights: np.ndarray, bits: int):
    """Posterior and score of each text."""
    posts, scores = [], []
    for _, off, data in text_chunks(column):
        n, q, shape, doc, _ = _measures(off, data)
        code = pattern_codes(_votes(n, q))
        r, c, v = _features(n, q, shape, doc, bits)
        z = np.bincount(r, weights[c] * v, minlength=len(n)) + weights[-1]
        scores.append(np.where(n > 0, 1 / (1 + np.exp(-z)), 0.0))
        posts.append(np.array([float(posterior.get(int(x), 0.5)) if k else 0.0 for x, k in zip(code, n)]))
    return (np.concatenate(posts), np.concatenate(scores)) if posts else (np.zeros(0), np.zeros(0))


def _score(batches, model, threshold):
    for batch in batches:
        p, s = _judge(batch.column(1), *model.value)
        yield pa.record_batch([batch.column(0), pa.array(p), pa.array(s), pa.array(s >= threshold)],
                              names=["id", "posterior", "score", "keep"])


def _keep(batches, model, threshold):
    for batch in batches:
        _, s = _judge(batch.column(batch.num_columns - 1), *model.value)
        yield batch.select(range(batch.num_columns - 1)).filter(pa.array(s >= threshold))


def fit(texts: DataFrame, sample: int = SAMPLE, bits: int = HASH_BITS):
    """``(posterior by vote pattern, scorer weights, bits)`` from ``texts(text)``."""
    spark = texts.sparkSession
    table = (arrow_map(texts, _pattern_rows, "code long, n long").where("code >= 0")
             .groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toPandas())
    codes, counts = table["code"].to_numpy(np.int64), table["n"].to_numpy(np.int64)
    post = estimate(codes, counts)[2] if len(codes) else []
    posterior = dict(zip(codes.tolist(), map(float, post)))
    shared = spark.sparkContext.broadcast(posterior)
    share = sample / max(int(counts.sum()), 1)
    picked = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = arrow_map(picked, lambda it: _sample_rows(it, shared, bits),
                     "p double, cols array<int>, vals array<double>").toPandas()
    if not len(rows):
        return posterior, np.zeros((1 << bits) + 1), bits
    w = fit_scorer(rows["p"].to_numpy(float), [np.asarray(c, np.int64) for c in rows["cols"]],
                   [np.asarray(c, float) for c in rows["vals"]], bits)
    return posterior, w, bits


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
            bits: int = HASH_BITS, threshold: float = THRESHOLD) -> DataFrame:
    """``(id, posterior, score, keep)`` per row: the label model's posterior of
    "good", the scorer's probability, and whether it reaches ``threshold``.

    Null, empty and wordless texts score 0 and are not kept.  Ids may be null or
    repeated; other columns are not read; an empty table gives an empty
    result."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(texts.select("text"), sample, bits))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, posterior double, score double, keep boolean"
    return arrow_map(texts, lambda it: _score(it, model, threshold), schema).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, bits: int = HASH_BITS,
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``; decided
    row by row, so nothing is joined."""
    text = F.col(text_col).cast("string")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select(text.alias("text")), sample, bits))
    return arrow_map(docs.select("*", text.alias("_judged_text")), lambda it: _keep(it, model, threshold), docs.schema)


def op6_quality(spark, sf_dir):
    """Quality of every document from weak labels."""
    return quality(documents(spark, sf_dir))
