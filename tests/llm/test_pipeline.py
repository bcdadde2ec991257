"""The pipeline against a plain reading of its stages."""

import sys

import edge

sys.path.insert(0, edge.__file__.rsplit("/tests/", 1)[0])

import corpus_pipeline as C          # noqa: E402
from test_ngram_join import brute    # noqa: E402
from test_tokenizers import want     # noqa: E402

from tankwise.llm import decontaminate, quality, toxicity    # noqa: E402


def test_stages_follow_from_their_operators(spark, tmp_dir):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    assert names == ["quality", "toxicity", "near_duplicates", "decontamination", "encoding"]
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, sf)
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_dir}/{k}")
            out = spark.read.parquet(f"{tmp_dir}/{k}")
            after = {r["doc_id"]: r["text"] for r in out.collect()}
            assert all(before[i] == t for i, t in after.items())
        if name == "quality":
            assert set(after) == {r["doc_id"] for r in quality.quality(docs).where("keep").collect()}
        elif name == "toxicity":
            labels = spark.read.parquet(f"{sf}/labels.parquet").where(toxicity.held_out(5) != 0)
            assert set(after) == {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("score < 0.5").collect()}
        elif name == "near_duplicates":
            assert set(after) == {i for i, (_, c) in brute(list(before.items())).items() if i == c}
        elif name == "decontamination":
            gone = {r["doc_id"] for r in decontaminate.decontaminate(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - gone
        else:
            got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()}
            assert got == {i: want(t) for i, t in before.items()}
        docs = out


def test_edge_rows_pass_through(spark, tmp_dir):
    docs = edge.documents(spark)
    for k, (_, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        docs.write.parquet(f"{tmp_dir}/{k}")
        docs = spark.read.parquet(f"{tmp_dir}/{k}")
    assert docs.columns[:2] == ["doc_id", "n_tokens"]


PROSE = ("the river rose in spring and the farmers moved their cattle to the higher fields while old people told "
         "stories about floods of other years and children counted the boats that came down from the hills")


def test_rows_without_an_id_or_with_a_shared_one_are_kept(spark):
    """Stages 3 and 4 drop rows for their texts only."""
    def words(i):
        return " ".join(f"{w}{i}" for w in PROSE.split())
    rows = [(None, words(1)), (None, words(2)), (None, words(2)), (7, words(3)), (7, words(4)), (7, words(4)), (8, words(5)),
            (9, words(5) + " more"), (10, words(1)), (None, None), (None, None), (7, ""), (11, "")]
    docs = edge.documents(spark, rows)
    left = C.keep_distinct(spark, docs, "/root/testdata/sf0.001")
    assert left.columns == docs.columns
    texts = sorted((r["text"] or "").split("more")[0].strip() for r in left.collect())
    assert texts == sorted([words(i) for i in range(1, 6)] + [""] * 4)
    assert sorted(r["doc_id"] for r in left.where("doc_id in (8, 9)").collect()) == [8]
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").where("length(text) > 200").limit(1).collect()
    rows = [(None, words(1)), (None, "so " + items[0]["text"]), (7, words(3)), (7, items[0]["text"]), (8, words(2)), (None, None)]
    seen = C.keep_unseen(spark, edge.documents(spark, rows), "/root/testdata/sf0.001")
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in seen.collect()) == sorted(
        [(0, words(1)), (7, words(3)), (8, words(2)), (0, "")])


def test_stages_take_an_empty_table(spark):
    docs = edge.nothing(spark)
    for k, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0 and (k == 4 or out.columns == docs.columns)
