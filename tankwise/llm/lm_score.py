"""Language-model scoring (operator 2): gated recurrent model over whole texts.

1. Words that tasks see often become the frequent list (a bounded number).
2. All training tokens are counted exactly: frequent words inside the tasks, the
   others by a shuffle of (word, document) rows, whose sorted runs give every
   rare word's count.  A document takes its rare words as met once if it is
   training text and as never met if not; only rows of other counts go back to
   their documents.
3. The most frequent words are the network's head, in classes; everything else
   is its tail class.  Within the tail a word has its absolutely discounted
   unigram share, a word without training count the discounted mass (the same
   events as the base model's: one unknown word).
4. Every task trains the network on its training documents from the common start
   (the unigram model), back-propagating through windows; the tasks' parameters
   are averaged by tokens in a tree.
5. Every document is scored whole, the state running on from window to window.

Gradient steps are taken on every training document, so training grows with the
corpus.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankwise.llm import gru
from tankwise.llm.shared import arrow_map, documents, dropped, stored
from tankwise.llm.words import U, HashIndex, mix, text_chunks, word_bounds, word_hashes

FREQUENT = 1 << 18       # words counted inside tasks and known to the scoring tasks, at most
OFTEN = 8                # times a task must meet a word to propose it
HEAD = 1023              # head words besides the end of text
CLASSES = 32
HIDDEN = 16
TAIL_INPUTS = 256        # input vectors shared by tail words
DISCOUNT = 0.75
GRID = 2.0 ** 34         # rare words' logarithms are multiples of 1 / GRID: sums without rounding, so equal texts score alike
CHUNK = 1 << 23
SEED = 5
END = np.array([0x5851F42D4C957F2D], U)    # hash of the end of a text


def _tokens(batch, texts, train):
    """Per CHUNK of bytes: first row, rows, token hashes with ends, first token of
    each text, whether it is training text, its fingerprint.  Bytes are hashed in
    smaller pieces, which bounds the scratch arrays."""
    held = batch.column(train).to_numpy(zero_copy_only=False)
    hashes, counts, start, size = [], [], 0, 0

    def joined(row):
        h, n = np.concatenate(hashes), np.concatenate(counts)
        m = len(n)
        off = np.concatenate([[0], np.cumsum(n)])
        with np.errstate(over="ignore"):
            place = (np.arange(len(h)) - np.repeat(off[:-1], n)).astype(U)
            c = np.concatenate([[U(0)], np.cumsum(mix(h + place))])
        return row, m, h, off, held[row:row + m], (c[off[1:]] - c[off[:-1]]).view(np.int64)

    for row, off, data in text_chunks(batch.column(texts)):
        s, e, first = word_bounds(off, data)
        hashes.append(np.insert(word_hashes(data, s, e), first[1:], END[0]))
        counts.append(np.diff(first) + 1)
        size += len(data)
        if size >= CHUNK:
            yield joined(start)
            start, hashes, counts, size = row + len(off) - 1, [], [], 0
    if hashes:
        yield joined(start)


def _often(batches):
    for batch in batches:
        for _, _, h, off, train, _ in _tokens(batch, 1, 2):
            v, c = np.unique(h[np.repeat(train, np.diff(off))], return_counts=True)
            v, c = v[c >= OFTEN], c[c >= OFTEN]
            yield pa.record_batch([pa.array(v.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "n"])


def _keys(ids, f, train):
    """A row's 64-bit name: of its id and its text's fingerprint; odd for training text."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    of_id = mix(ids.cast(pa.int64()).fill_null(0).to_numpy().view(U), 1)
    name = mix(f.view(U) ^ np.where(null, mix(np.zeros(1, U), 2), of_id))
    return (name & ~U(1) | train.astype(U)).view(np.int64)


def _counted(batches, frequent):
    """Rows of a frequent word's training count (k null) and of rare words by
    document (k: its key)."""
    index = HashIndex(frequent.value)
    total = np.zeros(len(frequent.value), np.int64)
    names = ["h", "k", "n"]
    for batch in batches:
        ids = batch.column(0)
        for row, m, h, off, train, f in _tokens(batch, 1, 2):
            at = index.find(h)
            doc = np.repeat(np.arange(m), np.diff(off))
            total += np.bincount(at[(at >= 0) & train[doc]], minlength=len(total))
            rare = at < 0
            d, v = doc[rare], h[rare]
            order = np.lexsort((v, d))
            d, v = d[order], v[order]
            head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])])) if len(d) else np.zeros(0, np.int64)
            n = np.diff(np.append(head, len(d)))
            d, v = d[head], v[head]
            yield pa.record_batch([pa.array(v.view(np.int64)), pa.array(_keys(ids.slice(row, m), f, train)[d]),
                                   pa.array(n.astype(np.int32))], names=names)
    seen = np.flatnonzero(total)
    # counts beyond an int32 are split over rows
    parts = [(seen, np.minimum(total[seen], 2**31 - 1))]
    while (total[seen] - sum(p[1] for p in parts) > 0).any():
        parts.append((seen, np.minimum(total[seen] - sum(p[1] for p in parts), 2**31 - 1)))
    for at, n in parts:
        yield pa.record_batch([pa.array(frequent.value[at].view(np.int64)), pa.nulls(len(at), pa.int64()), pa.array(n.astype(np.int32))],
                              names=names)


def _rare_counts(batches):
    """Input sorted by word.  Rows (key, times in the document, training count) of
    training text with a count other than 1 and of other text with a count other
    than 0, and one row (k null) of totals: training tokens, distinct words.
    Only the run of the last word is carried from batch to batch."""
    left = None
    grand = np.zeros(2, np.int64)
    names = ["k", "n", "c"]
    for batch in batches:
        part = pa.table([batch.column(i) for i in range(3)], names=["h", "k", "n"])
        if left is not None:
            part = pa.concat_tables([left, part])
        h = part["h"].to_numpy()
        if len(h) == 0:
            continue
        cut = int(np.searchsorted(h, h[-1], "left"))
        left = part.slice(cut)
        if cut:
            yield _run_counts(part.slice(0, cut), grand, names)
    if left is not None and len(left):
        yield _run_counts(left, grand, names)
    yield pa.record_batch([pa.nulls(1, pa.int64()), pa.array(grand[:1]), pa.array(grand[1:])], names=names)


def _run_counts(part, grand, names):
    h, k, n = part["h"].to_numpy(), part["k"].to_numpy(), part["n"].to_numpy().astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    c = np.add.reduceat(n * (k & 1), head)
    grand += (c.sum(), (c > 0).sum())
    c = np.repeat(c, np.diff(np.append(head, len(h))))
    sent = c != (k & 1)
    return pa.record_batch([pa.array(k[sent]), pa.array(n[sent]), pa.array(c[sent])], names=names)


class Model:
    """What tasks need: the frequent words with counts, the head and the network."""

    def __init__(self, frequent, counts, tail_tokens, tail_words, hidden, classes, head, seed):
        self.frequent, self.counts = frequent, counts
        order = np.argsort(-counts, kind="stable")[:head]
        order = order[counts[order] > 0]
        end = np.flatnonzero(frequent == END[0])
        order = np.unique(np.concatenate([order, end]))
        self.target = np.full(len(frequent) + 1, -1, np.int32)      # last: a word not in the list
        self.target[order] = np.arange(len(order))
        in_tail = self.target[:-1] < 0
        self.tail_tokens = int(tail_tokens + counts[in_tail].sum())
        self.tail_words = int(tail_words + (counts[in_tail] > 0).sum())
        self.inputs = len(order) + TAIL_INPUTS
        self.network, self.tables = gru.start(counts[order].astype(float), self.tail_tokens, self.inputs, hidden, classes, seed)

    def prepare(self):
        if not hasattr(self, "index"):
            self.index = HashIndex(self.frequent)
        return self.index

    def feed(self, h):
        """(positions in the list, targets, inputs) of token hashes."""
        at = self.prepare().find(h)
        goal = self.target[at]
        given = np.where(goal >= 0, goal, self.inputs - TAIL_INPUTS + (h >> U(40)).astype(np.int64) % TAIL_INPUTS).astype(np.int64)
        return at, goal, given


def _train(batches, model):
    m = model.value
    p = {k: v.copy() for k, v in m.network.items()}
    memory, tokens = None, 0
    for batch in batches:
        for _, _, h, off, train, _ in _tokens(batch, 1, 2):
            use = np.flatnonzero(train)
            if len(use) == 0:
                continue
            n = np.diff(off)[use]
            rows = np.repeat(off[use] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            _, goal, given = m.feed(h[rows])
            memory = gru.train(p, m.tables, given, goal, np.concatenate([[0], np.cumsum(n)]), memory=memory)
            tokens += int(n.sum())
    yield pa.record_batch([pa.array([float(tokens)]), pa.array([pickle.dumps(p)], pa.binary())], names=["w", "p"])


def _average(batches):
    total, acc = 0.0, None
    for batch in batches:
        for w, p in zip(batch.column(0).to_pylist(), batch.column(1)):
            if w > 0:
                p = pickle.loads(p.as_py())
                acc = {k: v * w for k, v in p.items()} if acc is None else {k: acc[k] + v * w for k, v in p.items()}
                total += w
    if acc is not None:
        mean = {k: (v / total).astype(np.float32) for k, v in acc.items()}
        yield pa.record_batch([pa.array([total]), pa.array([pickle.dumps(mean)], pa.binary())], names=["w", "p"])


def _scored(batches, model):
    m = model.value
    tail = m.target[:-1] < 0
    log_count = np.append(np.log10(m.counts + 1.0), 0.0)
    share = np.log10(np.maximum(m.counts - DISCOUNT, 1e-9))
    log_tail = np.append(np.where(tail, np.where(m.counts > 0, share, 0.0), 0.0), 0.0)
    names = ["id", "k", "train", "n", "rare", "known", "tail", "unseen", "logs", "logp"]
    for batch in batches:
        ids = batch.column(0)
        for row, k, h, off, train, f in _tokens(batch, 1, 2):
            at, goal, given = m.feed(h)
            logp = gru.score(m.network, m.tables, given, goal, off) / math.log(10)
            listed = at >= 0
            seen = listed & (m.counts[np.maximum(at, 0)] > 0)
            of = lambda x: np.add.reduceat(x.astype(float), off[:-1])     # noqa: E731  every text has its end
            yield pa.record_batch([
                ids.slice(row, k), pa.array(_keys(ids.slice(row, k), f, train)), pa.array(train), pa.array(np.diff(off)),
                pa.array(of(~listed).astype(np.int64)), pa.array(of(seen).astype(np.int64)),
                pa.array(of(seen & (goal < 0)).astype(np.int64)), pa.array(of(listed & ~seen).astype(np.int64)),
                pa.array(of(log_count[at])), pa.array(logp + of(log_tail[at]))], names=names)


def lm_score(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", hidden: int = HIDDEN,
             classes: int = CLASSES, head: int = HEAD, frequent: int = FREQUENT, seed: int = SEED) -> DataFrame:
    """``(id, training, n_tokens, n_known, train_tokens, base_score, score)`` per
    row; ``training`` is a boolean column of ``docs``.

    Null and empty texts consist of their end alone.  Null ids count as a
    document id of their own; a null ``training`` is false; repeated rows are
    counted and scored each; other columns are not read.  Without training rows
    every token is unknown and the base score is 0 per token."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(training, F.lit(False)).alias("train"))
    top = (arrow_map(rows, _often, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "h").limit(frequent).select("h").toPandas())
    words = np.unique(np.concatenate([top["h"].to_numpy(np.int64).view(U), END]))
    shared = spark.sparkContext.broadcast(words)
    counted = stored(arrow_map(rows, lambda it: _counted(it, shared), "h long, k long, n int"), "counted")
    exact = counted.where("k is null").groupBy("h").agg(F.sum("n").alias("n")).toPandas()       # at most the list
    counts = np.zeros(len(words), np.int64)
    counts[np.searchsorted(words, exact["h"].to_numpy(np.int64).view(U))] = exact["n"].to_numpy(np.int64)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    other = stored(arrow_map(counted.where("k is not null").repartition(parts, "h").sortWithinPartitions("h"), _rare_counts,
                             "k long, n long, c long"), "other")
    dropped(counted)
    rare = other.where("k is null").agg(F.sum("n"), F.sum("c")).first()
    rare_tokens, rare_words = int(rare[0] or 0), int(rare[1] or 0)
    total = int(counts.sum()) + rare_tokens
    distinct = int((counts > 0).sum()) + rare_words

    model = Model(words, counts, rare_tokens, rare_words, hidden, classes, head, seed)
    if total:
        given = spark.sparkContext.broadcast(model)
        trained = arrow_map(rows, lambda it: _train(it, given), "w double, p binary")
        trained = arrow_map(trained.repartition(16), _average, "w double, p binary")
        mean = arrow_map(trained.repartition(1), _average, "w double, p binary").first()
        if mean is not None:
            model.network = pickle.loads(bytes(mean["p"]))
    given = spark.sparkContext.broadcast(model)
    scored = (arrow_map(rows, lambda it: _scored(it, given), "id long, k long, train boolean, n long, rare long, known long, "
                        "tail long, unseen long, logs double, logp double").repartition(parts, "k")
              .groupBy("id", "k", "train", "n").agg(*[F.first(c).alias(c) for c in ("rare", "known", "tail", "unseen", "logs", "logp")],
                                                    F.count("*").alias("copies")))
    # what rows of other counts add to their document's sums; shuffled as they are, summed behind the shuffle
    odd = F.col("k").bitwiseAND(F.lit(1))
    on_grid = lambda x: F.rint(x * GRID) / GRID     # noqa: E731
    once, once_less = (round(math.log10(x) * GRID) / GRID for x in (2, 1 - DISCOUNT))        # of a word met once
    by_doc = (other.where("k is not null").withColumn("n", F.col("n").cast("int")).repartition(parts, "k").groupBy("k").agg(
        F.sum("n").alias("m"), F.sum(F.col("n") * (on_grid(F.log10(F.col("c") + 1)) - odd * once)).alias("m_logs"),
        F.sum(F.col("n") * (on_grid(F.log10(F.col("c") - DISCOUNT)) - odd * once_less)).alias("m_discounted")))
    mine = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("copies")       # noqa: E731  equal rows share a key
    both = scored.join(by_doc, "k", "left").withColumns({
        "r_known": F.when(F.col("train"), F.col("rare")).otherwise(F.round(mine("m")).cast("long")),
        "r_logs": mine("m_logs") + F.when(F.col("train"), F.col("rare") * once).otherwise(0.0),
        "r_discounted": mine("m_discounted") + F.when(F.col("train"), F.col("rare") * once_less).otherwise(0.0),
    }).withColumn("r_unknown", F.col("rare") - F.col("r_known"))
    events = math.log10(total + distinct + 1.0)
    tail_tokens = max(model.tail_tokens, 1)
    unknown_share = math.log10(max(DISCOUNT * model.tail_words, 1e-9) / tail_tokens) if model.tail_words else 0.0
    out = both.select(
        F.col("id").alias(id_col), F.col("train").alias("training"), F.col("n").alias("n_tokens"),
        (F.col("known") + F.col("r_known")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("r_logs") - F.col("n") * F.lit(events)).alias("base_score"),
        (F.col("logp") + F.col("r_discounted") - (F.col("tail") + F.col("r_known")) * F.lit(math.log10(tail_tokens))
         + (F.col("unseen") + F.col("r_unknown")) * F.lit(unknown_share)).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")


def op2_lm_score(spark, sf_dir):
    """Log-likelihood of every document under a recurrent model of six sevenths."""
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    out = lm_score(documents(spark, sf_dir), remainder != 2)
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
