"""Toxicity (operator 4): Levenshtein automata intersected with a lexicon trie.

Training rows are labelled documents whose crc32(doc_id) mod 5 is not 0.  From a
bounded sample of them

* stems that mark toxic documents are found: word prefixes with their toxic and
  clean document counts and the number of different words in front of them, so
  that a word that merely sits in copies of a toxic text does not enter;
* the lexicon trie is intersected with the Levenshtein automaton of distance one:
  a machine state is the set of (trie node, edits so far) alive after the letters
  read, made on first use; unlike words die after a few letters;
* every (term, edits) gets the log-odds of its matches, so a misspelling that is
  an ordinary word elsewhere weighs nothing;
* a logistic model weighs a document's matches with their context windows:
  matches inside quotation marks or after words of reporting count as quoted,
  the others as abuse.

All documents are scored over their whole texts.  Labels, language, source and id
are not inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankwise.llm.shared import arrow_map, documents

SAMPLE = 24_000          # training documents, at most about this many
PREFIXES = (3, 10)       # stem lengths
MIN_DOCS = 8             # toxic training documents that a stem needs
PURITY = 0.88            # share of toxic among the documents of a stem
MIN_CONTEXTS = 7         # different words in front of it, so that copies of one text do not make a term
MAX_STEMS = 4000         # candidates, those of most documents
MAX_TERMS = 200
WINDOW = 6               # words on each side of a match
WORD = re.compile(r"[^\W\d_]+")
QUOTES = re.compile("[\"“”„«»‘’]")
# fixed words: reporting of someone else's words
REPORTING = frozenset("said says quoted quote wrote writes called calls cites cited termed "
                      "sagte schrieb nannte zitiert dit disait écrit appelle cite dijo escribió llamó cita".split())


# ------------------------------------------------------------------- matching
class Matcher:
    """Lexicon trie x Levenshtein automaton (distance 1 for terms of 4 letters or
    more).  ``terms`` are ``(stem, whole)``: a whole term ends where the word
    ends, a stem may go on."""

    def __init__(self, terms):
        self.children, self.term, self.open = [{}], [None], [False]
        self.fuzzy, self.short = [False], set()
        for i, (stem, whole) in enumerate(terms):
            at = 0
            for c in stem:
                nxt = self.children[at].get(c)
                if nxt is None:
                    nxt = self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.open.append(False)
                    self.fuzzy.append(False)
                at = nxt
                self.fuzzy[at] |= len(stem) >= 4
            self.fuzzy[0] |= len(stem) >= 4
            self.term[at], self.open[at] = i, not whole
            if len(stem) < 4:
                self.short.add(i)
        start = self._closed({(0, 0)})
        self.sets, self.number = [start], {start: 0}
        self.moves = [{}]
        self.found = [self._accept(start)]
        self.cache: dict[str, tuple[int, int] | None] = {}

    def _closed(self, items):
        """Adds what a letter left out of the word gives (one edit)."""
        out = set(items)
        for node, e in items:
            if e == 0:
                out |= {(k, 1) for k in self.children[node].values() if self.fuzzy[k]}
        best = {}
        for node, e in out:
            best[node] = min(e, best.get(node, 9))
        return frozenset(best.items())

    def _accept(self, state):
        """Best stem match and best match were the word to end: (edits, term)."""
        ends = [(e, self.term[n], self.open[n]) for n, e in state
                if self.term[n] is not None and not (e and self.term[n] in self.short)]
        stems = sorted((e, t) for e, t, o in ends if o)
        return (stems[0] if stems else None), (min((e, t) for e, t, _ in ends) if ends else None)

    def _move(self, state, c):
        items = set()
        for node, e in self.sets[state]:
            kids = self.children[node]
            if c in kids and (e == 0 or self.fuzzy[kids[c]]):
                items.add((kids[c], e))
            if e == 0 and self.fuzzy[node]:
                items.add((node, 1))
                items |= {(k, 1) for k in kids.values() if self.fuzzy[k]}
        new = self._closed(items)
        to = self.number.get(new)
        if to is None:
            to = self.number[new] = len(self.sets)
            self.sets.append(new)
            self.moves.append({})
            self.found.append(self._accept(new))
        self.moves[state][c] = to
        return to

    def match(self, word: str):
        """``(term, edits)`` of the closest term, or None."""
        state, best = 0, None
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if not self.sets[state]:
                return best and (best[1], best[0])
            stem = self.found[state][0]
            if stem is not None and (best is None or stem < best):
                best = stem
        end = self.found[state][1]
        if end is not None and (best is None or end < best):
            best = end
        return best and (best[1], best[0])

    def words(self, words):
        """Matches of the given words as {word: (term, edits)}."""
        if len(self.cache) > 150_000:
            self.cache.clear()
        known, out = self.cache, {}
        for w in words:
            if w not in known:
                known[w] = self.match(w)
            m = known[w]
            if m is not None:
                out[w] = m
        return out


def matches(matcher: Matcher, text: str):
    """``[(term, edits, quoted)]`` of a text and its number of words."""
    low = text.lower()
    words = WORD.findall(low)
    hit = matcher.words(set(words))
    if not hit:
        return [], len(words)
    spans = [m.span() for m in WORD.finditer(low)]
    out = []
    for i, w in enumerate(words):
        if w in hit:
            a, b = spans[max(0, i - WINDOW)][0], spans[min(len(spans) - 1, i + WINDOW)][1]
            before, after = low[a:spans[i][0]], low[spans[i][1]:b]
            quoted = len(QUOTES.findall(before)) % 2 == 1 and bool(QUOTES.search(after))
            told = any(x in REPORTING for x in words[max(0, i - WINDOW):i])
            out.append((*hit[w], 1.0 * quoted + 0.5 * told))
    return out, len(words)


def inputs(found, n, weights) -> list[float]:
    """Inputs of the logistic model; ``weights[edits][term]`` are log-odds."""
    if not found:
        return [0.0] * 5
    plain = [weights[e][t] * (1 if q < 0.5 else 0.5 if q < 1 else 0.2) for t, e, q in found]
    quoted = [weights[e][t] for t, e, q in found if q >= 0.5]
    return [max(plain), float(np.log1p(sum(plain))), float(np.log1p(100 * sum(plain) / max(n, 1))),
            max(quoted, default=0.0), float(np.log1p(sum(e == 0 for _, e, _ in found)))]


# -------------------------------------------------------------------- learning
def _stems_of(words) -> set[str]:
    lo, hi = PREFIXES
    return {w[:k] for w in words for k in range(lo, min(len(w), hi) + 1)}


def _stem_counts(batches):
    """Per chunk of training texts and stem of its toxic ones: toxic document
    count, words equal to the stem, and a 64-bit map of the words met in front."""
    lo, hi = PREFIXES
    for batch in batches:
        tox, whole, before = Counter(), Counter(), {}
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not y:
                continue
            words = WORD.findall(t.lower())
            first = {}
            for prev, w in zip(["", *words], words):
                first.setdefault(w, prev)
            mine = {}
            for w, prev in first.items():
                whole[w] += 1
                bit = 1 << (xxhash.xxh32_intdigest(prev) & 63)
                for k in range(lo, min(len(w), hi) + 1):
                    mine[w[:k]] = mine.get(w[:k], 0) | bit
            tox.update(mine.keys())
            for s, bits in mine.items():
                before[s] = before.get(s, 0) | bits
        stems = list(tox)
        maps = np.array([before[s] for s in stems], np.uint64).view(np.int64)
        yield pa.record_batch([pa.array(stems, pa.string()), pa.array([whole[s] for s in stems], pa.int64()),
                               pa.array([tox[s] for s in stems], pa.int64()), pa.array(maps)],
                              names=["stem", "whole", "tox", "before"])


def _clean_counts(batches, stems):
    """Clean documents of each of ``stems``, over all training texts."""
    for batch in batches:
        clean = Counter()
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not y:
                clean.update(_stems_of(set(WORD.findall(t.lower()))) & stems.value)
        yield pa.record_batch([pa.array(list(clean), pa.string()), pa.array(list(clean.values()), pa.int64())],
                              names=["stem", "clean"])


def find_stems(training: DataFrame):
    """``stem, whole, tox`` of the stems that mark toxic documents: those of enough
    toxic documents first, then their clean documents in every batch."""
    stems = (arrow_map(training, _stem_counts, "stem string, whole long, tox long, before long")
             .groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("whole", "tox")], F.bit_count(F.bit_or("before")).alias("contexts"))
             .where((F.col("tox") >= MIN_DOCS) & (F.col("contexts") >= MIN_CONTEXTS)).toPandas())
    # bounded by the words of the sample's toxic documents
    known = training.sparkSession.sparkContext.broadcast(frozenset(stems["stem"]))
    clean = (arrow_map(training, lambda it: _clean_counts(it, known), "stem string, clean long")
             .groupBy("stem").agg(F.sum("clean").alias("clean")).toPandas())
    count = dict(zip(clean["stem"], clean["clean"]))
    pure = [(s, w, t) for s, w, t in zip(stems["stem"], stems["whole"], stems["tox"]) if t >= PURITY * (t + count.get(s, 0))]
    return sorted(pure, key=lambda r: (-r[2], -len(r[0]), r[0]))[:MAX_STEMS]


def choose_terms(stems, most: int = MAX_TERMS):
    """Lexicon from ``(stem, whole, tox)``: a stem that no shorter chosen stem
    covers, lengthened while one longer stem keeps nearly all its documents."""
    count = {s: t for s, _, t in stems}
    whole = {s: w for s, w, _ in stems}
    by_parent: dict[str, list[str]] = {}
    for s in count:
        by_parent.setdefault(s[:-1], []).append(s)
    terms, taken = [], set()
    for s in sorted(count, key=lambda s: (len(s), -count[s], s)):
        if any(s[:k] in taken for k in range(1, len(s))):
            continue
        taken.add(s)
        while True:
            nxt = max(by_parent.get(s, []), key=lambda c: count[c], default=None)
            if nxt is None or count[nxt] < 0.95 * count[s]:
                break
            s = nxt
        terms.append((s, whole[s] >= 0.9 * count[s], count[s]))
    terms.sort(key=lambda t: (-t[2], t[0]))
    return [(s, w) for s, w, _ in terms[:most]]


def _train_rows(batches, matcher):
    for batch in batches:
        out = [matches(matcher.value, t) for t in batch.column(0).to_pylist()]
        yield pa.record_batch([batch.column(1), pa.array([n for _, n in out], pa.int64()),
                               pa.array([[x for m in f for x in m] for f, _ in out], pa.list_(pa.float64()))],
                              names=["toxic", "n", "found"])


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights, bias last (Newton steps, ridge)."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + decay * w
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + decay * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(training: DataFrame):
    """``(terms, weights, logistic weights)`` from ``training(text, toxic)``, a
    bounded sample."""
    spark = training.sparkSession
    terms = choose_terms(find_stems(training))
    matcher = spark.sparkContext.broadcast(Matcher(terms))
    rows = arrow_map(training, lambda it: _train_rows(it, matcher), "toxic int, n long, found array<double>").toPandas()
    found = [[(int(f[i]), int(f[i + 1]), f[i + 2]) for i in range(0, len(f), 3)] for f in rows["found"]]
    y = rows["toxic"].to_numpy(float)
    seen = np.zeros((2, max(len(terms), 1), 2))
    for f, t in zip(found, y):
        for term, e in {(term, e) for term, e, _ in f}:
            seen[e, term, int(t)] += 1
    base = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0
    weights = np.maximum(np.log((seen[..., 1] + 0.5) / (seen[..., 0] + 0.5)) - base, 0.0)
    weights = np.where(seen.sum(axis=2) > 0, weights, [[0.0], [2.0]])    # an unseen misspelling of a term counts a little
    x = np.array([inputs(f, n, weights) for f, n in zip(found, rows["n"])]).reshape(len(y), 5)
    return terms, weights, fit_logistic(x, y) if len(y) else np.array([0.0] * 5 + [-3.0])


def _judge(column, matcher, weights, logistic) -> np.ndarray:
    out = np.zeros(len(column))
    for i, t in enumerate(column):
        found, n = matches(matcher, t.as_py() or "")
        z = float(np.dot(inputs(found, n, weights), logistic[:-1]) + logistic[-1])
        out[i] = 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))
    return out


def _score(batches, model):
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array(_judge(batch.column(1), *model.value))], names=["id", "score"])


def _keep(batches, model, limit):
    for batch in batches:
        last = batch.num_columns - 1
        yield batch.select(range(last)).filter(pa.array(_judge(batch.column(last), *model.value) < limit))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int):
    """Broadcast model from the labelled rows of ``docs``, about ``sample`` of them."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1)")
    share = min(1.0, sample / max(known.count(), 1))
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["id"])
    # the picked ids are bounded by the sample
    training = texts.where("text is not null").join(F.broadcast(picked), "id").select("text", "toxic")
    terms, weights, logistic = fit(training)
    return docs.sparkSession.sparkContext.broadcast((Matcher(terms), weights.tolist(), logistic.tolist()))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """``(id, score)`` per row of ``docs``.

    ``labels(id, label)`` are the rows that may be learned from.  Null or empty
    texts have no match and get the score of a text without matches; without any
    label all scores are low.  Ids may be null or repeated; null labels are not
    used; other columns are not read."""
    model = learn(docs, labels, id_col, text_col, label_col, sample)
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
                     lambda it: _score(it, model),
                     f"id {docs.schema[id_col].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep_below(docs: DataFrame, labels: DataFrame, limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``limit``; decided
    row by row, so nothing is joined."""
    model = learn(docs, labels, id_col, text_col, label_col, sample)
    return arrow_map(docs.select("*", F.col(text_col).cast("string").alias("_judged_text")),
                     lambda it: _keep(it, model, limit), docs.schema)


def held_out(parts: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op4_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from four fifths of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(held_out(5) != 0)
    out = toxicity(documents(spark, sf_dir), labels)
    return out.select("doc_id", (held_out(5) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
