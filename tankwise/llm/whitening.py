"""Embedding whitening (operator 11): a bidiagonal qd solver over blockwise QR.

Vectors become whole numbers, each distinct one counts once.  Their sums are
exact; every task reduces its centred rows to one triangular factor by blockwise
QR, and the factors are reduced in groups until one is left, so no covariance
matrix is ever formed and its squared condition never enters.  That one d x d
factor is bidiagonalised on the driver (``bidiagonal.py``), which gives the
eigenvalues and directions; all rows are then projected in the tasks.

What travels is one d x d factor a task, then a sixteenth of these a round; the
driver holds d sums and one factor, d being the length of a vector."""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankwise.llm import bidiagonal
from tankwise.llm.shared import arrow_map, dropped, stored

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
LARGEST = 1e13               # entries beyond it have no exact whole number to stand for them
GROUP = 16                   # factors reduced together
BLOCK = 8_192                # rows of one QR step
RANK = 1e-10                 # singular values below this part of the largest count as zero


@dataclass
class Whitening:
    """``n`` distinct vectors, their exact sums, unit directions as columns of
    ``components`` with their eigenvalues, falling, and the sum of all eigenvalues."""
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = field(default=0.0)


def whole_numbers(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("long") + F.lit(OFFSET).cast("long"))


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, not empty, finite throughout and of the table's
    commonest length (the shorter of equally common ones)."""
    c = F.col(f"`{vector}`")
    good = df.where(c.isNotNull() & (F.size(c) > 0)).where(F.coalesce(F.forall(
        c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) <= F.lit(LARGEST))), F.lit(False)))
    common = good.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.where(F.size(c) == F.lit(common["d"] if common else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _near_mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole part and rest: sums = n * whole + rest, 0 <= rest < n."""
    return np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)


def _centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    return (x - whole).astype(np.float64) - rest.astype(np.float64) / n


def _reduced(rows: np.ndarray, d: int) -> np.ndarray:
    """Triangular factor of ``rows``, filled up with zero rows to d x d."""
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and exact sum of each place; one row a task and place is summed in Spark."""
    def run(batches):
        n, total = 0, [0] * d
        for b in batches:
            x = _matrix(b.column("x"), d)
            n += len(x)
            # halves of 32 bits: a batch's sums cannot pass 64 bits
            high, lower = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            total = [t + (h << 32) + w for t, h, w in zip(total, high.tolist(), lower.tolist())]
        if n:
            total.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(total, pa.decimal128(38, 0))],
                                             names=["place", "total"])
    rows = (arrow_map(fit, run, "place int, total decimal(38,0)").groupBy("place")
            .agg(F.sum("total").cast("string").alias("total")).collect())          # d + 1 rows
    by = {r["place"]: int(r["total"]) for r in rows}
    return by.get(d, 0), [by.get(i, 0) for i in range(d)]


FACTOR = "part int, factor binary"


def _factor(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The triangular factor of all centred rows of ``fit``."""
    d = len(sums)
    whole, rest = _near_mean(n, sums)

    def first(batches):
        from pyspark import TaskContext
        r, held, count = np.zeros((d, d)), [], 0
        for b in batches:
            held.append(_centred(_matrix(b.column("x"), d), whole, rest, n))
            count += len(held[-1])
            if count >= max(BLOCK, 4 * d):
                r, held, count = _reduced(np.vstack([r, *held]), d), [], 0
        r = _reduced(np.vstack([r, *held]), d)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()])],
                                         names=["part", "factor"])

    def merge(table: pa.Table) -> pa.Table:
        # order of the parts fixed, so that a repeated task gives the same factor
        got = sorted(zip(table["part"].to_pylist(), table["factor"].to_pylist()))
        r = _reduced(np.vstack([np.frombuffer(f, np.float64).reshape(d, d) for _, f in got]), d)
        return pa.table({"part": pa.array([got[0][0] // GROUP], pa.int32()), "factor": pa.array([r.tobytes()])})

    factors = stored(arrow_map(fit, first, FACTOR), "factors")
    parts = factors.agg(F.max("part")).first()[0] + 1
    while parts > 1:
        smaller = stored(factors.groupBy((F.col("part") / GROUP).cast("int").alias("group")).applyInArrow(merge, FACTOR), "factors")
        dropped(factors)
        factors, parts = smaller, -(-parts // GROUP)
    return np.frombuffer(factors.first()["factor"], np.float64).reshape(d, d)


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of ``vectors(x array<long>)``, each distinct vector counted once;
    None if there is no row.  Directions without spread are left out, so equal
    vectors only give no component at all."""
    first = vectors.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    fit = stored(vectors.select("x").distinct(), "fit")
    n, sums = _sums(fit, d)
    squares, directions = bidiagonal.leading(_factor(fit, n, sums), min(components, d))
    kept = int((squares[:min(components, d)] > RANK ** 2 * squares[0]).sum()) if squares[0] > 0 else 0
    model = Whitening(n, sums, directions[:, :kept], squares[:kept] / n, float(squares.sum() / n))
    model.identity_error = _identity_error(fit, model) if kept else 0.0
    dropped(fit)
    return model


def _projected(x: np.ndarray, model: Whitening, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return _centred(x, whole, rest, model.n) @ model.components / np.sqrt(model.eigenvalues)


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of (covariance of the whitened fit list - identity)."""
    d, k = model.components.shape
    whole, rest = _near_mean(model.n, model.sums)

    def run(batches):
        total = np.zeros(k * k + k)
        for b in batches:
            w = _projected(_matrix(b.column("x"), d), model, whole, rest)
            total += np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["place", "total"])
    rows = arrow_map(fit, run, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
    got = np.zeros(k * k + k)
    for r in rows:                                                     # k * k + k rows
        got[r["place"]] = r["total"] / model.n
    mean = got[k * k:]
    return float(np.abs(got[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _deviation(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> list[int | None]:
    """Sum over places of (n x - S)^2, exact; None where a long cannot hold it."""
    off = x - whole
    widest = n * int(np.abs(off).max(initial=0)) + n
    if widest * widest * x.shape[1] < 1 << 63:
        return ((n * off - rest) ** 2).sum(axis=1).tolist()
    small = [int(v) for v in rest]
    out = []
    for row in off.tolist():
        total = sum((n * v - r) ** 2 for v, r in zip(row, small))
        out.append(total if total < 1 << 63 else None)
    return out


OUT = [("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"),
       ("identity_error", "double")]


def whiten(df: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)``: one row
    for each usable row of ``df`` and each component.

    Rows whose vector is null, empty, holds null or non-finite entries, entries
    beyond 1e13, or another than the table's commonest length are left out.
    Repeated rows each give their rows but count once in the fit; a null key
    stays null; other columns are not read.  With fewer directions of spread than
    ``components`` only these are returned, so a table that is empty or holds one
    distinct vector gives an empty result.  Equal eigenvalues give some orthonormal
    directions of their space, the same for all rows.  ``deviation`` is null where
    a long cannot hold it."""
    good = usable(df, vector).select(F.col(f"`{key}`").alias("key"), whole_numbers(F.col(f"`{vector}`")).alias("x"))
    model = fit_whitening(good, components)
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *T._parse_datatype_string(", ".join(f"{a} {b}" for a, b in OUT)).fields])
    if model is None or model.components.shape[1] == 0:
        return df.sparkSession.createDataFrame([], schema)
    d, k = model.components.shape
    whole, rest = _near_mean(model.n, model.sums)
    explained = [float(Fraction(e) / Fraction(model.trace)) for e in model.eigenvalues]
    names = schema.names

    def run(batches):
        for b in batches:
            m = b.num_rows
            if m == 0:
                continue
            x = _matrix(b.column("x"), d)
            w = _projected(x, model, whole, rest)
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                b.column("key").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)), pa.array(_deviation(x, model.n, whole, rest), pa.int64()).take(at),
                pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error))], names=names)
    return arrow_map(good, run, schema)


def op11_whitening(spark, sf_dir):
    """All embeddings on the first 16 whitened directions."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
