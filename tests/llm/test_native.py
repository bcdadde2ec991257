import random
import zlib

import edge
from pyspark.sql import functions as F

from tankwise.llm import decontaminate, external_shuffle, licenses


def plan(df):
    return df._jdf.queryExecution().toString()


# ------------------------------------------------------------ external shuffle
def test_shards_hold_every_row_once(spark):
    sf = "/root/testdata/sf0.01"
    rows = external_shuffle.op10_external_shuffle(spark, sf).collect()
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["size"] == len(docs[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]]) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_many_buckets_repeats_and_clashing_names(spark, tmp_dir):
    docs = edge.documents(spark)
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long")
    out = external_shuffle.external_shuffle(docs, size, shards=5, bucket_bytes=20_000)
    rows = out.collect()
    assert sorted((r["record"]["doc_id"] is None, r["record"]["doc_id"] or 0) for r in rows) == \
        sorted((i is None, i or 0) for i, _ in edge.TEXTS)
    assert set(rows[0]["record"].asDict()) == set(docs.columns)
    places = [r["slot"] * 5 + r["shard"] for r in rows]
    assert sorted(places) == list(range(len(rows)))
    external_shuffle.write_shards(out, tmp_dir + "/shards")
    back = spark.read.parquet(tmp_dir + "/shards")
    assert back.count() == len(rows) and back.select("_shard").distinct().count() == 5
    assert external_shuffle.external_shuffle(edge.nothing(spark), size).count() == 0


def test_order_is_random_and_follows_the_seed(spark):
    df = spark.range(3000).withColumn("text", F.lit("x" * 50)).repartition(4)
    run = lambda seed: [r["record"]["id"] for r in external_shuffle.external_shuffle(
        df, F.lit(58).cast("long"), shards=3, seed=seed, bucket_bytes=30_000).orderBy("shard", "slot").collect()]
    a, b = run(1), run(2)
    assert a != b and sorted(a) == sorted(b)
    fixed = sum(x < y for x, y in zip(a, a[1:]))
    assert 0.4 < fixed / len(a) < 0.6


# ------------------------------------------------------------- decontamination
def best_windows(docs, items, limit):
    import math
    index, shingle = {}, {}
    for i, t in items.items():
        w = t.lower().split()
        k = min(5, len(w))
        shingle[i] = (len(w), k, {tuple(w[j:j + k]) for j in range(len(w) - k + 1)})
        for s in shingle[i][2]:
            index.setdefault(s, set()).add(i)
    weight = {s: 1 / (1 + math.log(len(v))) for s, v in index.items()}
    out = {}
    for d, t in docs.items():
        w = t.lower().split()
        for i, (n, k, own) in items and shingle.items():
            best = 0
            for a in range(max(1, len(w) - n + 1)):
                part = w[a:a + n]
                have = {tuple(part[j:j + k]) for j in range(len(part) - k + 1)}
                best = max(best, sum(weight[s] for s in own & have) / sum(weight[s] for s in own))
            if best >= limit - 1e-9:
                out[d, i] = best
    return out


def test_windows_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    items = {i: " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 40))) for i in range(25)}
    items[25] = items[3] + " tail"
    docs = {}
    for d in range(150):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if d % 2:
            part = items[rng.randrange(26)].split()
            for _ in range(rng.randint(0, 2)):
                op, at = rng.random(), rng.randrange(len(part))
                if op < 0.4:
                    part[at] = rng.choice(vocab)
                elif op < 0.7:
                    part.insert(at, rng.choice(vocab))
                elif len(part) > 3:
                    del part[at]
            at = rng.randint(0, len(w))
            w[at:at] = part
        docs[d] = " ".join(w).upper()
    want = best_windows(docs, items, decontaminate.SIMILARITY)
    out = decontaminate.decontaminate(spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
                                      spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in out.collect()}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_edited_passages_of_templated_and_copied_items_are_found(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(4000)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]     # noqa: E731
    template, copied = words(34), words(40)
    items = {i: " ".join(template + words(6)) for i in range(60)}
    items |= {100 + i: " ".join(copied[:39] + [f"end{i}"]) for i in range(60)}
    items |= {200 + i: " ".join(words(40)) for i in range(20)}
    docs = {}
    for d in range(160):
        part = items[rng.choice(list(items))].split()
        for at in rng.sample(range(len(part)), rng.randint(1, 2)):
            part[at] = f"new{d}"
        docs[d] = " ".join(words(30) + part + words(30))
    want = best_windows(docs, items, decontaminate.SIMILARITY)
    out = decontaminate.decontaminate(spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
                                      spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in out.collect()}
    assert len(want) > 300 and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_decontamination_edge_rows(spark):
    docs = edge.documents(spark)
    items = spark.createDataFrame([(1, edge.PASSAGE), (1, edge.PASSAGE), (2, None), (3, ""), (None, "a b c d e f"), (4, "one two three"),
                                   (5, "one")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {(7, 1), (8, 1), (9, 1), (5, 4), (6, 4), (4, 5), (5, 5), (6, 5)}
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == 0
    assert decontaminate.decontaminate(edge.nothing(spark), items).count() == 0


def test_no_python_in_the_plans(spark):
    sf = "/root/testdata/sf0.001"
    for df in (decontaminate.op9_decontaminate(spark, sf), external_shuffle.op10_external_shuffle(spark, sf)):
        assert "Python" not in plan(df) and "InArrow" not in plan(df) and "InPandas" not in plan(df)


# --------------------------------------------------------------------- licences
def test_notices_are_found_and_prose_is_not(spark):
    notices = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.",
               "GPL": "This work is licensed under the GNU General Public License, version 3.",
               "CC-BY-NC": "Licensed under CC BY-NC 4.0.", "Proprietary": "All rights reserved."}
    rows = [(i, f"Some prose of the day, under the tree.\n{t}\nAll of it is the work of one hand.") for i, t in enumerate(notices.values())]
    rows += [(100 + i, f"The license of poets is wide number {i}.\nUnder the rights of the sea, version of a tale.") for i in range(30)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, edge.LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = licenses.scan(docs)
    assert "InArrow" not in plan(out) and "PythonUDF" not in plan(out)
    got = {(r["doc_id"], r["line"]): r["family"] for r in out.collect()}
    assert got == {(i, 1): f for i, f in enumerate(notices)}


def test_every_paragraph_trains_and_calibrates(spark, monkeypatch):
    """All paragraphs, short ones too, reach the unknown class with their counts; none is sampled."""
    rows = [(i, "\n".join(f"the work of hand {i % 7}" if j % 2 else f"zq{i} zq{j}" for j in range(1000))) for i in range(30)]
    docs = spark.createDataFrame(rows + rows[:1] + [(100, "Released under the MIT License.")], "doc_id long, text string")
    seen, real = [], licenses.train

    def train(found, bare, *rest):
        seen.append((found.where("size(x) > 0").count(), bare))
        return real(found, bare, *rest)
    monkeypatch.setattr(licenses, "train", train)
    got = [(r["doc_id"], r["family"]) for r in licenses.scan(docs).collect()]
    assert got == [(100, "MIT")] and seen == [(15_001, 15_000)]


def test_scan_of_an_empty_table(spark):
    assert licenses.scan(edge.nothing(spark)).count() == 0
