import re
import random
from itertools import combinations

import edge
import numpy as np
import pyarrow as pa

from tankwise.llm import ngram_join as J
from tankwise.llm.words import shingles_of_texts


def shingles(text, k=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for (a, x), (b, y) in combinations(sets, 2):
        both = len(x & y)
        if both and 100 * both >= 75 * len(x | y):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_shingles_match_a_plain_reading():
    texts = ["", "a", "A b\tc", "a b c d e", "A B c d e f a b c d e f", " x\x0by\x0cz\r\n q Ä ä", "é è"]
    out = [b - a for _, _, off in shingles_of_texts(pa.array(texts), 5) for a, b in zip(off[:-1], off[1:])]
    assert out == [len(shingles(t)) for t in texts]


def test_edge_rows(spark):
    rows = J.ngram_join(edge.documents(spark)).collect()
    assert len(rows) == len(edge.TEXTS)
    assert {(r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is None} == {(17, None), (0, None)} \
        or all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    want = brute([(i, t) for i, t in dict(x for x in edge.TEXTS if x[0] is not None).items()])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == want


def test_empty_table(spark):
    assert J.ngram_join(edge.nothing(spark)).count() == 0


def test_random_near_copies_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows, i = [], 0
    for size in (3, 6, 9, 15, 30, 60, 120):
        base = [rng.choice(vocab) for _ in range(size)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 12))):
                op, at = rng.random(), rng.randrange(len(w))
                if op < 0.4:
                    w[at] = rng.choice(vocab)
                elif op < 0.7:
                    w.insert(at, rng.choice(vocab))
                elif len(w) > 1:
                    del w[at]
            rows.append((i, " ".join(w)))
            i += 1
    for _ in range(60):        # one passage in many texts, with little of their own
        own = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        rows.append((i, " ".join(passage + own)))
        i += 1
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(J.ngram_join(df)) == want
    # the same whatever counts as frequent, and with large buckets cut into blocks
    monkeypatch.setattr(J, "FREQUENT", 2)
    monkeypatch.setattr(J, "SMALL_BUCKET", 3)
    monkeypatch.setattr(J, "BLOCK", 8)
    assert got(J.ngram_join(df)) == want


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(J.op1_ngram_join(spark, sf)) == brute(rows)


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
        b = np.unique(np.concatenate([a[:rng.integers(1, 200)], rng.integers(0, 2**63, 30).astype(np.uint64)]))
        x, y = (np.frombuffer(J._sketch(v), np.uint8) for v in (a, b))
        while len(x) > len(y):
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
        while len(y) > len(x):
            y = y[:len(y) // 2] ^ y[len(y) // 2:]
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
