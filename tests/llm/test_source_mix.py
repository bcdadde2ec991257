import re
from collections import Counter, defaultdict

import edge
import pytest
from pyspark.sql import functions as F

from tankwise.llm import source_mix as M


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=M.WEIGHTS, ratio=M.RATIO, cap=M.CAP):
    """Water-filling by hand: share, stop, share the excess again."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, free = {}, ratio * sum(sizes.values()), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            out.update({s: level * w[s] for s in free})
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_stop_and_reshare(spark):
    sizes = {"b": 10, "a": 1000, None: 700, "é": 5000, "z": 0, "\U0001f642": 40, "￮": 9}
    got = M.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    got = {r["source"]: r for r in got.collect()}
    want = targets(sizes)
    assert set(got) == set(sizes)
    for s, t in want.items():
        assert got[s]["target"] == pytest.approx(t, rel=1e-12) and got[s]["source_size"] == sizes[s]
        assert got[s]["target"] <= 2 * sizes[s]
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_whole_table_near_its_targets(spark):
    sf = "/root/testdata/sf0.1"
    rows = M.op12_source_mix(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    size = {d["doc_id"]: words(d["text"]) for d in docs}
    source = {d["doc_id"]: d["source"] for d in docs}
    assert Counter(r["doc_id"] for r in rows) == Counter(d["doc_id"] for d in docs)
    sums = Counter()
    for d in docs:
        sums[d["source"]] += size[d["doc_id"]]
    want, taken, spread = targets(sums), Counter(), defaultdict(float)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[s]
        assert r["target"] == pytest.approx(want[s], rel=1e-12)
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        p = want[s] / sums[s] % 1
        spread[s] += r["size"] ** 2 * p * (1 - p)
        taken[s] += r["taken"]
    for s in sums:
        assert abs(taken[s] - want[s]) <= 4.5 * spread[s] ** 0.5 + 1


def test_same_rows_whatever_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = [sorted(map(tuple, M.mix_plan(d).collect()), key=repr) for d in (docs.coalesce(1), docs.repartition(23))]
    assert one == many


def test_a_third_of_equal_rows_draw_independently(spark, monkeypatch):
    monkeypatch.setattr(M, "NUMBERED", 700)
    rows = [(None, "same words here", "a")] * 4000 + [(i, "w " * 8, "b" if i % 2 else None) for i in range(6000)]
    plan = M.mix_plan(table(spark, rows).repartition(7)).where("source = 'a'")
    got = plan.agg(F.count("*"), F.sum(F.col("copies") * F.col("size")), F.first("target"), F.max("copies"), F.min("copies")).first()
    assert got[0] == 4000 and got[3] - got[4] <= 1
    assert abs(got[1] - got[2]) < 0.05 * got[2]


def test_awkward_rows(spark):
    docs = edge.documents(spark)
    plan = M.mix_plan(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in plan) == Counter((i, words(t)) for i, t in edge.TEXTS)
    assert M.mix_plan(edge.nothing(spark)).count() == 0 and M.mixed(edge.nothing(spark)).count() == 0
    empty = M.mix_plan(table(spark, [(1, None, None), (2, "", "x")])).collect()
    assert all(r["target"] == 0 and r["copies"] == 0 for r in empty)


def test_the_mix_holds_what_the_plan_says(spark):
    docs = edge.documents(spark).withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("doc_id").cast("string")))
    docs = docs.unionAll(docs.where("doc_id in (5, 8, 9) or doc_id is null"))
    out = M.mixed(docs)
    assert set(out.schema["record"].dataType.names) == set(docs.columns)
    want = Counter()
    for r in M.mix_plan(docs).collect():
        want[(r["doc_id"], r["size"])] += r["copies"]
    got = Counter((r["record"]["doc_id"], words(r["record"]["text"])) for r in out.collect())
    assert got == +want


def test_no_python_on_the_executors(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (M.mix_plan(docs), M.mixed(docs)):
        p = df._jdf.queryExecution().toString()
        assert "Python" not in p and "InArrow" not in p and "InPandas" not in p and "CartesianProduct" not in p
