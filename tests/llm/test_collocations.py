import random
import re
from collections import Counter

import edge
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tankwise.llm import collocations as C
from tankwise.llm.fm_index import Index, bwt, text_of


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def counted(rows, longest=4):
    f = Counter()
    for lang, text in rows:
        for w in pieces(text):
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[(lang or "und", tuple(w[i:i + k]))] += 1
    return f


def brute(rows, least=30, top=2000):
    f = counted(rows)
    n = Counter()
    for (lang, p), c in f.items():
        n[lang] += c * (len(p) == 1)
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        inside = any(100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                     for (m, q), b in cand.items() if m == lang and len(q) > len(p))
        if not inside:
            cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
                  for lang, best in out.items() for i, (s, a, p, left, right) in enumerate(sorted(best)[:top]))


def table(spark, rows):
    return spark.createDataFrame([(i, lang, text, "z", 1) for i, (lang, text) in enumerate(rows)],
                                 "doc_id long, lang string, text string, phrase string, f int")


# --------------------------------------------------------------- the index
@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=9), max_size=12))
def test_intervals_count_all_grams(rows):
    ids = np.array([x for r in rows for x in r], np.int32)
    opens = np.array([i == 0 for r in rows for i in range(len(r))], bool)
    text = text_of(ids, opens)
    index = Index(bwt(text, 4), bwt(text[::-1], 4), 6)
    want = Counter(tuple(r[i:i + k]) for r in rows for k in range(1, 5) for i in range(len(r) - k + 1))
    every = np.array([False] + [True] * 5)
    for sides in (["left"] * 3, ["right"] * 3, ["left", "right", "left"], ["right", "left", "right"]):
        g = index.unigrams(every)
        g = g.where(g.count > 0)
        for k in range(1, 5):
            got = {tuple(w): c for w, c in zip(g.words.tolist(), g.count.tolist())}
            assert got == {p: c for p, c in want.items() if len(p) == k}
            if k < 4:
                g = index.extend(g, sides[k - 1], every)


def test_words_and_pieces():
    import pyarrow as pa
    texts = ["One two,three", "", None, " A\tB . \n ", "é!ñ x", "x"]
    from tankwise.llm.words import text_chunks
    got = []
    for _, off, data in text_chunks(pa.array(texts), 7):
        words, opens = C._words(off, data)
        got += list(zip(words.to_pylist(), opens.tolist()))
    want = [(w, i == 0) for t in texts for p in pieces(t) for i, w in enumerate(p)]
    assert got == want


# ------------------------------------------------------------- the operator
def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r["lang"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, C.op13_collocations(spark, sf).collect())) == want


def invented(seed, n=900):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice("ab B c d é 日本 x-y ''".split(" ")) for _ in range(rng.randint(0, 14))]
        out.append((rng.choice(["en", None, "und", "ß"]), "".join(w + rng.choice([" ", "  ", "\t", " ", ", ", ".", "\n"]) for w in words)))
    return out + [("en", "New York City Hall is near"), ("en", "new york city  hall is near")] * 40 + [(None, None), ("en", ""), (None, "..")]


@pytest.mark.parametrize("shard,parts", [(1 << 20, 3), (50, 9)])
def test_shards_do_not_matter(spark, shard, parts):
    rows = invented(1)
    found = C.collocations(table(spark, rows).repartition(parts), shard=shard)
    assert sorted(map(tuple, C.best_phrases(found).collect())) == brute(rows)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_BITS", 1 << 6)
    monkeypatch.setattr(C, "BITS_EACH", 1)
    rows = invented(2)
    assert sorted(map(tuple, C.best_phrases(C.collocations(table(spark, rows), shard=300)).collect())) == brute(rows)


def test_top_ties_and_extensions(spark):
    rows = [("en", f"p{i:03d} q{i:03d}") for i in range(60) for _ in range(30)] + [("en", "p000 q000 r")] * 10
    got = C.best_phrases(C.collocations(table(spark, rows)), top=25).collect()
    assert [r["phrase"] for r in got] == [f"p{i:03d} q{i:03d}" for i in range(25)]
    assert [r["rank"] for r in got] == list(range(1, 26)) and got[0]["a"] == 40
    found = {r["phrase"]: r for r in C.collocations(table(spark, [("en", "x a b y")] * 30 + [("en", "a b y")] * 5 + [("en", "a b")] * 10)).collect()}
    assert (found["a b"]["left_best"], found["a b"]["right_best"]) == (30, 35)
    assert (found["x a b y"]["left_best"], found["x a b y"]["right_best"]) == (None, None)


def test_awkward_rows(spark):
    assert C.best_phrases(C.collocations(edge.nothing(spark))).count() == 0
    docs = edge.documents(spark)
    got = sorted(map(tuple, C.best_phrases(C.collocations(docs, min_count=2)).collect()))
    assert got == brute([(None, t) for _, t in edge.TEXTS], least=2)
