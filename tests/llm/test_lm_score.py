import cProfile
import math
import pstats
import re
import zlib
from collections import Counter

import edge
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tankwise.llm import gru, lm_score


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [None]


def check(rows, texts, held):
    count = Counter(w for k, t in texts.items() if not held(k) for w in words(t))
    n, v = sum(count.values()), len(count)
    for r in rows:
        w = words(texts[r["doc_id"]])
        assert r["n_tokens"] == len(w) and r["train_tokens"] == n
        assert r["n_known"] == sum(count[x] > 0 for x in w)
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] <= 0


def test_query_counts_exactly_and_beats_the_base(spark):
    sf = "/root/testdata/sf0.01"
    rows = lm_score.op2_lm_score(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    check(rows, texts, lambda k: zlib.crc32(str(k).encode()) % 7 == 2)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_rare_words_shuffled_give_the_same_counts(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(lm_score, "FREQUENT", 40)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lm_score.lm_score(docs, F.col("doc_id") % 3 != 0, frequent=40, head=20).collect()
    check(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, lambda k: k % 3 == 0)


def test_edge_rows(spark):
    rows = lm_score.lm_score(edge.documents(spark), F.col("doc_id") != 11).collect()
    assert len(rows) == len(edge.TEXTS)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert len([r for r in rows if r["doc_id"] == 8]) == 2
    assert lm_score.lm_score(edge.nothing(spark), F.lit(True)).count() == 0
    none = lm_score.lm_score(edge.documents(spark), F.lit(False)).collect()
    assert len(none) == len(edge.TEXTS) and all(r["n_known"] == 0 and r["base_score"] == 0 for r in none)


def network(seed=0):
    counts = np.random.default_rng(seed).integers(1, 50, 30).astype(float)
    p, tables = gru.start(counts, 40.0, 40, 6, 4, seed)
    rng = np.random.default_rng(seed + 1)
    for k in p:
        p[k] = p[k].astype(np.float64) + rng.normal(size=p[k].shape) * 0.1
    return p, tables


def test_probabilities_sum_to_one():
    p, tables = network()
    state = np.random.default_rng(3).normal(size=(1, 6))
    goals = np.arange(-1, 30)
    logp, _ = gru.output(p, tables, np.repeat(state, len(goals), 0), goals)
    assert math.isclose(np.exp(logp).sum(), 1, rel_tol=1e-9)


def test_state_is_carried_across_windows(monkeypatch):
    p, tables = network()
    rng = np.random.default_rng(4)
    goal, given = rng.integers(-1, 30, 200), rng.integers(0, 40, 200)
    off = np.array([0, 90, 91, 200])
    whole = None
    for window in (7, 32, 500):
        monkeypatch.setattr(gru.windows, "__defaults__", (window,))
        s = gru.score(p, tables, given, goal, off, width=2)
        assert whole is None or np.allclose(s, whole)
        whole = s


def test_every_training_document_is_trained_on():
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 50, 12)) for _ in range(90)]
    batch = pa.record_batch([pa.array(range(90)), pa.array(texts), pa.array([i % 7 != 2 for i in range(90)])], names=["id", "text", "train"])
    h = np.concatenate([t[2] for t in lm_score._tokens(batch, 1, 2)])
    words, counts = np.unique(h, return_counts=True)

    class Sent:
        value = lm_score.Model(words, counts, 0, 0, 4, 4, 30, 1)
    out = list(lm_score._train([batch], Sent))
    assert out[0].column(0).to_pylist() == [13.0 * sum(i % 7 != 2 for i in range(90))]


def test_training_lowers_the_loss_and_gradients_are_right():
    p, tables = network()
    rng = np.random.default_rng(5)
    given = np.tile(np.arange(20), 60)
    goal = np.tile((np.arange(20) + 1) % 20, 60)
    off = np.arange(0, 1201, 100)
    before = gru.score(p, tables, given, goal, off).sum()
    memory = None
    for _ in range(60):
        memory = gru.train(p, tables, given, goal, off, memory=memory)
    assert gru.score(p, tables, given, goal, off).sum() > 0.6 * before
    states, goals = rng.normal(size=(5, 6)), rng.integers(-1, 30, 5)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    _, back = gru.output(p, tables, states, goals, grads)
    loss = lambda: -gru.output(p, tables, states, goals)[0].sum()     # noqa: E731
    for array, grad in ((p["c"], grads["c"]), (p["w"], grads["w"]), (states, back)):
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        array[at] += 1e-5
        up = loss()
        array[at] -= 2e-5
        assert math.isclose((up - loss()) / 2e-5, grad[at], rel_tol=1e-3)
        array[at] += 1e-5


def test_rows_of_one_id_and_text_count_apart_by_training(spark):
    text = "apple pear plum plum"
    docs = spark.createDataFrame([(1, text, True), (1, text, False), (None, text, False), (-1, text, True), (-1, text, True),
                                  (2, "fig fig kiwi", False)], "doc_id long, text string, t boolean")
    rows = lm_score.lm_score(docs, F.col("t"), frequent=1, head=1).collect()
    count = Counter(words(text) * 3)
    for r in rows:
        w = words("fig fig kiwi" if r["doc_id"] == 2 else text)
        assert r["n_known"] == sum(count[x] > 0 for x in w) and r["train_tokens"] == 15
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 1) / (15 + 4 + 1)) for x in w), rel_tol=1e-9)
    assert len(rows) == 6 and len({r["score"] for r in rows if r["doc_id"] != 2}) == 1


def test_rare_words_of_one_text_are_not_sent_back(spark, monkeypatch):
    sent = {}
    store = lm_score.stored
    monkeypatch.setattr(lm_score, "stored", lambda df, name: sent.setdefault(name, store(df, name)))
    docs = spark.createDataFrame([(i, f"a{i} b{i} b{i} c{i}", i % 5 > 0) for i in range(50)], "doc_id long, text string, t boolean")
    lm_score.lm_score(docs, F.col("t"), frequent=1, head=1).collect()
    rows = [t.dropna().count() for name, t in sent.items() if name != "counted"]
    assert rows == [40]          # the words met twice in a training text


def test_few_calls_for_a_window():
    """Arrays are small: a call for each class and quantity would cost more than the work."""
    rng = np.random.default_rng(7)
    p, tables = gru.start(rng.integers(1, 500, 1000).astype(float), 40.0, 1256, 16, 32, 1)
    given, goal = rng.integers(0, 1256, 640), rng.integers(-1, 1000, 640)
    profile = cProfile.Profile()
    profile.runcall(gru.train, p, tables, given, goal, np.arange(0, 641, 32))
    assert pstats.Stats(profile).total_calls < 600


def test_gradients_through_a_window_are_right():
    p, tables = network()
    rng = np.random.default_rng(8)
    off = np.cumsum([0, 20, 7, 1, 13])
    given, goal = rng.integers(0, 40, off[-1]), rng.integers(-1, 30, off[-1])
    loss = lambda: -gru.score(p, tables, given, goal, off).sum() / off[-1]      # noqa: E731
    after, far = {k: v.copy() for k, v in p.items()}, 1e12        # AdaGrad's memory: steps in proportion to the gradient
    dense = sum(v.size for k, v in p.items() if k != "x")
    gru.train(after, tables, given, goal, off, rate=1.0, memory={"x": np.full_like(p["x"], far), "dense": np.full(dense, far)})
    for k, v in p.items():
        grad = (v - after[k]) * math.sqrt(far)
        for at in rng.choice(v.size, 5, replace=False):
            at = np.unravel_index(at, v.shape)
            v[at] += 1e-5
            up = loss()
            v[at] -= 2e-5
            assert math.isclose((up - loss()) / 2e-5, grad[at], rel_tol=1e-3, abs_tol=1e-7)
            v[at] += 1e-5


def test_a_long_text_does_not_hold_up_lanes(monkeypatch):
    """Few windows score one long text and many short ones, each as if alone."""
    p, tables = network()
    rng = np.random.default_rng(9)
    off = np.cumsum([0, 3200] + [320] * 60 + [1, 33, 64])
    given, goal = rng.integers(0, 40, off[-1]), rng.integers(-1, 30, off[-1])
    made, forward = [], gru._forward
    monkeypatch.setattr(gru, "_forward", lambda *a: made.append(1) or forward(*a))
    scores = gru.score(p, tables, given, goal, off, width=8)
    assert len(made) <= 110
    for a, b, s in zip(off[:-1], off[1:], scores):
        assert math.isclose(gru.score(p, tables, given[a:b], goal[a:b], np.array([0, b - a]))[0], s, rel_tol=1e-9)


def test_windows_train_each_token_once_and_empty_rows_none():
    lengths = np.array([90, 70, 64, 33, 32, 5, 1, 1, 0, 0])
    for refill in (False, True):
        seen = [np.zeros(n, int) for n in lengths]
        for docs, at, steps, _ in gru.windows(lengths, 3, 16, refill=refill):
            assert len(docs) <= 3
            for d, a in zip(docs, at):
                seen[d][a:a + steps] += 1
        assert all((s == 1).all() for s in seen)
