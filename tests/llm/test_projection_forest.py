import numpy as np

from tankwise.llm import projection_forest as P


def brute(ids, x, cosine=0.9):
    s = x @ x.T >= cosine
    np.fill_diagonal(s, False)
    label = np.array(ids)
    while True:
        low = np.minimum(label, np.where(s, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (low == label).all():
            return s.sum(axis=1), label
        label = low


def planted(n=1500, dim=32, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n, 3):        # near copies over the whole range above 0.9
        x[i + 1] = x[i] / np.linalg.norm(x[i]) + rng.normal(size=dim) * rng.uniform(0.01, 0.09)
    x[100:140] = x[99]              # exact copies
    x[200:230] = x[199] * 2 + rng.normal(size=(30, dim)) * 0.05
    return x.astype(np.float32)


def test_recall_and_precision_on_planted_links(spark, monkeypatch):
    x = planted()
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links, label = brute(np.arange(len(x)), unit)
    for block in (P.BLOCK, 20):
        rows = {r["vec_id"]: r for r in P.near_vectors(df, leaf=40, block=block).collect()}
        got = np.array([rows[i]["n_links"] for i in range(len(x))])
        assert (got <= links).all() and got.sum() >= 0.95 * links.sum()
        comp = np.array([rows[i]["component_id"] for i in range(len(x))])
        assert np.mean(comp == label) > 0.97
        assert all(rows[i]["kept"] == (comp[i] == i) for i in range(len(x)))


def test_large_near_groups_keep_their_links(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(2, 64))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    x = np.concatenate([rng.normal(size=(3000, 64)) / 8,
                        centre[0] + rng.normal(size=(2500, 64)) * 0.2 / 8,       # cosine 0.96
                        centre[1] + rng.normal(size=(800, 64)) * 0.32 / 8])      # about the threshold
    x[5600:5630] = x[5599]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    links, label = brute(np.arange(len(x)), x / np.linalg.norm(x, axis=1)[:, None])
    t = P.near_vectors(df, block=700).toPandas().set_index("vec_id").loc[np.arange(len(x))]
    got = t["n_links"].to_numpy()
    assert (got <= links).all() and got[3000:].sum() >= 0.99 * links[3000:].sum()
    assert np.mean(t["component_id"].to_numpy() == label) > 0.99


def test_recall_on_the_given_table(spark):
    sf = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.stack([np.asarray(v, float) for v in t["embedding"]])
    links, _ = brute(t["vec_id"].to_numpy(), x / np.linalg.norm(x, axis=1)[:, None])
    got = P.op3_projection_forest(spark, sf).toPandas().set_index("vec_id").loc[t["vec_id"], "n_links"].to_numpy()
    assert (got <= links).all() and got.sum() >= 0.9 * links.sum()


def test_edge_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]),
            (8, [float("inf"), 1.0]), (9, [1.0]), (10, [0.0, 1.0]), (10, [0.0, 1.0]), (None, [1.0, 0.0]), (11, [1e300, 0.0]), (12, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, v string")
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in P.near_vectors(df).collect()),
                 key=lambda r: (r[0], r[1]))
    assert got == [(0, 0, None, False), (1, 4, 1, True), (2, 4, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True),
                   (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 4, 1, False), (10, 1, 10, True), (10, 1, 10, True),
                   (11, 4, 1, False), (12, 4, 1, False)]
    assert P.near_vectors(df.limit(0)).count() == 0
