import math
from collections import Counter

import numpy as np
import pytest

from tankwise.llm import bidiagonal, whitening


def brute(vectors):
    x = np.array([[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors], dtype=object)
    fit = sorted({tuple(r) for r in x})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(n * a - b) / n for a, b in zip(r, s)] for r in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    mine = np.array([[float(n * a - b) / n for a, b in zip(r, s)] for r in x])
    return n, e[::-1], v[:, ::-1], deviation, mine


def compared(rows, ids, vectors, components=16):
    n, e, v, deviation, mine = brute(vectors)
    k = min(components, len(e), int((e > 1e-18 * e[0]).sum()))
    assert len(rows) == len(ids) * k
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    for c in range(1, k + 1):
        want = mine @ v[:, c - 1] / np.sqrt(e[c - 1])
        got = np.array([by[i][c]["whitened"] for i in ids])
        sign = np.sign(want @ got)
        np.testing.assert_allclose(got * sign, want, rtol=1e-7, atol=1e-7)
    for i, d in zip(ids, deviation):
        for c in range(1, k + 1):
            r = by[i][c]
            assert r["n"] == n and r["deviation"] == d and r["identity_error"] < 1e-9
            assert r["explained"] == pytest.approx(e[c - 1] / e.sum(), rel=1e-9)


def test_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = whitening.op11_whitening(spark, sf).collect()
    table = [r for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()
             if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    compared(rows, [r["vec_id"] for r in table], [r["embedding"] for r in table])


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, "z", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, x string, n int")


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.normal(size=6) * [9, 5, 3, 2, 1, 0.5]]) for i in range(400)]
    good += [(1000 + i, good[7][1]) for i in range(300)] + [(None, good[9][1])]
    bad = [(2000, None), (2001, []), (2002, [1.0] * 5 + [None]), (2003, [float("nan")] * 6), (2004, [float("inf")] + [1.0] * 5),
           (2005, [1.0, 2.0]), (2006, [1e300] * 6)]
    rows = whitening.whiten(table(spark, good + bad).repartition(5), "vec_id", "embedding").collect()
    compared(rows, [i for i, _ in good], [v for _, v in good])
    assert rows[0]["n"] == 400


def test_repeated_ids_and_other_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(1 if i % 2 else i, [float(c) for c in rng.normal(size=4) * [4, 3, 2, 1]]) for i in range(200)]
    a = whitening.whiten(table(spark, rows).coalesce(1), "vec_id", "embedding", 3).collect()
    b = whitening.whiten(table(spark, rows, "float").repartition(40), "vec_id", "embedding", 3).collect()
    assert Counter(r["vec_id"] for r in a) == Counter({i: 3 * c for i, c in Counter(i for i, _ in rows).items()})
    va, vb = (sorted((r["component"], abs(r["whitened"])) for r in x) for x in (a, b))
    np.testing.assert_allclose(va, vb, rtol=1e-6, atol=1e-6)


def test_little_spread(spark):
    assert whitening.whiten(table(spark, []), "vec_id", "embedding").count() == 0
    assert whitening.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(5)]), "vec_id", "embedding").count() == 0
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(50)]               # one direction only
    got = whitening.whiten(table(spark, line), "vec_id", "embedding").collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1.0)
    compared(got, [i for i, _ in line], [v for _, v in line])


def test_a_deviation_too_large_for_a_long_is_null(spark):
    big = [(0, [1e12, 0.0]), (1, [-1e12, 1.0]), (2, [0.0, 2.0])]
    rows = whitening.whiten(table(spark, big), "vec_id", "embedding").collect()
    by = {r["vec_id"]: r["deviation"] for r in rows}
    assert by[0] is None and by[1] is None and by[2] is not None


@pytest.mark.parametrize("name", ["random", "graded", "identity", "levels", "low rank", "zeros"])
def test_solver_against_svd(name):
    rng = np.random.default_rng(5)
    d = 40
    r = {"random": lambda: rng.standard_normal((d, d)), "graded": lambda: rng.standard_normal((d, d)) * np.logspace(0, -8, d),
         "identity": lambda: np.eye(d), "zeros": lambda: np.diag([3.0, 3, 3, 2, 2, 1] + [0] * (d - 6)),
         "levels": lambda: np.linalg.qr(rng.standard_normal((d, d)))[0] @ np.diag([5.0] * 10 + [1.0] * 30),
         "low rank": lambda: np.vstack([rng.standard_normal((6, d)), np.zeros((d - 6, d))])}[name]()
    k = 6
    squares, z = bidiagonal.leading(r, k)
    want = np.linalg.svd(r)[1] ** 2
    np.testing.assert_allclose(squares, want, rtol=1e-11, atol=1e-14 * want[0])
    assert np.abs(z.T @ z - np.eye(k)).max() < 1e-11
    assert np.abs(r.T @ (r @ z) - z * squares[:k]).max() < 1e-12 * squares[0]


def test_small_singular_values_keep_their_digits():
    a, b = np.array([1.0, 1e-6, 1e-12]), np.array([1e-3, 1e-9])
    got = bidiagonal.squared_singular_values(a, b)
    assert np.prod(np.sqrt(got)) == pytest.approx(1e-18, rel=1e-12)           # the determinant
    assert np.sqrt(got[-1]) == pytest.approx(1e-12, rel=1e-6)
