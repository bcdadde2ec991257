import edge
import numpy as np

from tankwise.llm import quality, toxicity


def test_labeller_model_finds_accuracies():
    rng = np.random.default_rng(2)
    y = rng.random(20000) < 0.85
    labellers = (("a", quality.BAD, 0.85), ("b", quality.BAD, 0.85), ("c", quality.GOOD, 0.7), ("d", quality.GOOD, 0.7))
    rate = np.array([[0.6, 0.5, 0.2, 0.3], [0.02, 0.05, 0.9, 0.8]])
    votes = rng.random((20000, 4)) < rate[y.astype(int)]
    codes, counts = np.unique(quality.pattern_codes(votes), return_counts=True)
    prior, found, post = quality.estimate(codes, counts, labellers)
    assert abs(prior - 0.85) < 0.03 and np.abs(found - rate).max() < 0.06
    label = dict(zip(codes.tolist(), post > 0.5))
    assert np.mean([label[c] == t for c, t in zip(quality.pattern_codes(votes).tolist(), y)]) > 0.93


def test_quality_agrees_with_held_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op6_quality(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.join(labels, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1]
    bad = [r for r in rows if r["quality"] == 0]
    assert np.mean([r["keep"] for r in good]) > 0.97
    assert np.mean([not r["keep"] for r in bad]) > 0.9


def test_quality_edge_rows(spark):
    docs = edge.documents(spark)
    rows = quality.quality(docs).collect()
    assert len(rows) == len(edge.TEXTS)
    assert all(r["score"] == 0 and not r["keep"] for r in rows if r["doc_id"] in (1, 2, 3))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.where("text is null or trim(text) = ''").count() == 0
    assert quality.quality(edge.nothing(spark)).count() == 0
    assert quality.keep_good(edge.nothing(spark)).count() == 0


def edits(word):
    letters = "abcdefghijklmnopqrstuvwxyz"
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return ({a + b[1:] for a, b in cut if b} | {a + c + b for a, b in cut for c in letters}
            | {a + c + b[1:] for a, b in cut if b for c in letters})


def test_automaton_accepts_exactly_distance_one():
    m = toxicity.Matcher([("stupid", True), ("moron", True), ("lowei", False), ("ab", True)])
    for term in ("stupid", "moron"):
        assert all(m.match(w) is not None for w in edits(term))
    assert m.match("stupid") == (0, 0) and m.match("stupyd") == (0, 1) and m.match("ab") == (3, 0)
    for w in ("stupor", "morals", "stpd", "xab", "a", "", "zzzz"):
        assert m.match(w) is None, w
    assert m.match("loweischaft") == (2, 0) and m.match("loweyschaft") == (2, 1)


def test_quoted_matches_weigh_less():
    m = toxicity.Matcher([("moron", True)])
    plain, n = toxicity.matches(m, "you are a moron and that is all")
    quoted, k = toxicity.matches(m, 'she said "you moron" to nobody')
    w = [[5.0], [2.0]]
    assert toxicity.inputs(plain, n, w)[0] == 5.0 and toxicity.inputs(quoted, k, w)[0] < 2.0


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.op4_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert np.mean(clean) < 0.01 and np.mean(toxic) > 0.85


def test_lexicon_does_not_follow_the_partitions(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))     # noqa: E731
    common = [word() for _ in range(60)]
    texts = [(" ".join([*rng.choice(common, 12), *(["zzmoron", common[i % 9]] if i % 8 == 0 else []), *rng.choice(common, 12)]), int(i % 8 == 0))
             for i in range(800)]
    texts.sort(key=lambda r: r[1])
    rows = spark.createDataFrame(texts, "text string, toxic int")
    whole = toxicity.find_stems(rows.coalesce(1))
    assert whole and all("zzmoron".startswith(s) for s, _, _ in whole)
    assert toxicity.find_stems(rows.repartitionByRange(200, "toxic", "text")) == whole
    assert toxicity.find_stems(rows.repartition(200)) == whole


def test_toxicity_edge_rows(spark):
    docs = edge.documents(spark)
    labels = spark.createDataFrame([(7, 1, 1), (10, 0, None), (None, 0, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(edge.TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    none = labels.limit(0)
    assert toxicity.toxicity(edge.nothing(spark), none).count() == 0
    assert toxicity.keep_below(docs, none).columns == docs.columns
