"""Embedding near duplicates (operator 3): random-projection tree forest.

* Equal vectors are one class (a group of exact copies of any size is one row).
* Dense groups come first, as a median split cuts through a group that is most of
  a node: balls of the threshold's angle around centres found in the sample.  A
  ball's *core* (within the angle) is compared with everything within twice the
  angle, which holds all its links, and goes no further; so a pair with a core
  member is met in one ball exactly, and the trees hold the other pairs.  Core
  members within half the angle are linked to one another by the triangle
  inequality: they are counted, not compared.
* Trees are fitted on a bounded sample of classes: a node projects on the
  difference of two of its points and splits at the median; points between the
  quantiles 0.5 -+ SPILL go to both children.  Every vector is then routed
  through every tree, into one or more leaves of each.
* Vectors are compared within leaves.  A leaf with more than BLOCK members is cut
  into blocks by hash and every pair of blocks is compared on its own, so no task
  holds an unbounded leaf and none of its pairs is lost.
* Found pairs are verified by cosine in double precision.  A pair that shares
  several leaves counts in the first of them only: each member carries its
  leaves, so link counts need no table of pairs.  A leaf also yields its local
  components, which are then united over all leaves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankwise.llm.shared import arrow_map, components, stored
from tankwise.session import ship_package

COSINE = 0.9
TREES = 8
SPILL = 0.06
LEAF = 96                # sample points in a leaf
SAMPLE = 50_000          # classes that the trees are fitted on, at most
BLOCK = 2048
DENSE = 96               # sample points that a ball holds at least
PIVOTS = 4096            # sample points tried as centres
SEED = 7


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows in double precision, and whether each is usable.  Null, zero and
    non-finite vectors are not; shorter ones count as padded with zeros."""
    n = len(column)
    out = np.zeros((n, dim))
    good = np.zeros(n, bool)
    if n and column.null_count == 0 and column.values.null_count == 0:
        lengths = np.diff(column.offsets.to_numpy())
        if (lengths == dim).all():
            out = column.flatten().to_numpy().astype(float).reshape(n, dim)
            good[:] = True
    if not good.any():
        for i, v in enumerate(column.to_pylist()):
            if v and None not in v:
                out[i, :len(v)] = v
                good[i] = True
    good &= np.isfinite(out).all(axis=1)
    out[~good] = 0
    peak = np.abs(out).max(axis=1, initial=0)
    good &= peak > 0
    out /= np.where(peak > 0, peak, 1)[:, None]
    norm = np.sqrt((out * out).sum(axis=1))
    return out / np.where(good, norm, 1)[:, None], good


# ----------------------------------------------------------------------- balls
def find_balls(x: np.ndarray, cosine: float, dense: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of dense groups in the sample, largest first, and the sample points
    in no core."""
    rng = np.random.default_rng(seed)
    free, centres = np.ones(len(x), bool), []
    pivots = rng.permutation(len(x))[:PIVOTS]
    if cosine <= 0 or len(x) <= dense:
        return np.zeros((0, x.shape[1])), free
    small = x.astype(np.float32)
    count = np.zeros(len(pivots), np.int64)
    for a in range(0, len(x), 4096):
        count += (small[a:a + 4096] @ small[pivots].T >= cosine).sum(axis=0)
    for p in pivots[np.argsort(-count, kind="stable")][:int((count >= dense).sum())]:
        if not free[p]:
            continue
        mine = free & (x @ x[p] >= cosine)
        if mine.sum() < dense:
            continue
        centre = x[mine].sum(axis=0)
        centre /= np.sqrt(centre @ centre)
        core = x @ centre >= cosine
        if (core & free).sum() >= dense:
            centres.append(centre)
            free &= ~core
    return np.array(centres).reshape(-1, x.shape[1]), free


def in_balls(x: np.ndarray, centres: np.ndarray, cosine: float) -> tuple[list[list[int]], np.ndarray]:
    """Per row its balls as ``ball << 2 | core << 1 | tight``, ending with the one
    that it is a core member of, and whether it is in no core."""
    out: list[list[int]] = [[] for _ in range(len(x))]
    free = np.ones(len(x), bool)
    if len(centres):
        angle = math.acos(cosine)
        near = x @ centres.T
        # a hair wider and narrower than the angles, for rounding
        reach, tight = math.cos(min(2 * angle, math.pi)) - 1e-9, math.cos(angle / 2) + 1e-9
        for b in range(len(centres)):
            for r in np.flatnonzero(free & (near[:, b] >= reach)).tolist():
                out[r].append(b << 2 | (near[r, b] >= cosine) << 1 | (near[r, b] >= tight))
            free &= near[:, b] < cosine
    return out, free


# ----------------------------------------------------------------------- trees
def fit_forest(x: np.ndarray, trees: int, leaf: int, spill: float, seed: int) -> list[list]:
    """Each tree is a list of nodes: ``(direction, low, high, left, right)`` or
    None for a leaf."""
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        nodes: list = [None]
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if len(rows) <= leaf:
                continue
            for _ in range(4):
                a, b = rng.choice(rows, 2, replace=False)
                d = x[a] - x[b]
                size = np.sqrt(d @ d)
                if size < 1e-9:
                    continue
                d = d / size
                proj = x[rows] @ d
                low, high = np.quantile(proj, [0.5 - spill, 0.5 + spill])
                left, right = rows[proj <= high], rows[proj >= low]
                if max(len(left), len(right)) <= 0.8 * len(rows):
                    nodes[at] = (d.astype(np.float32), float(low), float(high), len(nodes), len(nodes) + 1)
                    todo += [(len(nodes), left), (len(nodes) + 1, right)]
                    nodes += [None, None]
                    break
        forest.append(nodes)
    return forest


def route(x: np.ndarray, nodes: list) -> list[list[int]]:
    """Leaves of every row of ``x`` in one tree, ascending."""
    out: list[list[int]] = [[] for _ in range(len(x))]
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if len(rows) == 0:
            continue
        if nodes[at] is None:
            for r in rows.tolist():
                out[r].append(at)
            continue
        d, low, high, left, right = nodes[at]
        proj = x[rows] @ d.astype(float)
        todo += [(left, rows[proj <= high]), (right, rows[proj >= low])]
    return [sorted(v) for v in out]


def _route(batches, dim, forest, centres, cosine):
    for batch in batches:
        x, good = _matrix(batch.column("v"), dim)
        keep = np.flatnonzero(good)
        x = x[keep]
        balls, free = in_balls(x, centres.value, cosine)
        flat: list[list[int]] = [[] for _ in range(len(x))]
        rest = np.flatnonzero(free)
        for t, nodes in enumerate(forest.value):
            for r, leaves in zip(rest.tolist(), route(x[rest], nodes)):
                flat[r] += [t << 24 | leaf for leaf in leaves]
        pick = pa.array(keep)
        yield pa.record_batch([*(batch.column(c).take(pick) for c in ("id", "copies", "v")),
                               pa.array(flat, pa.list_(pa.int32())), pa.array([[int(c) for c in b] for b in balls], pa.list_(pa.int32()))],
                              names=["id", "copies", "v", "leaves", "balls"])


# ---------------------------------------------------------------------- leaves
def _compare(key, table: pa.Table, dim: int, cosine: float) -> pa.Table:
    """One leaf, or one pair of its blocks: local component and weight of the
    first-met links of each member."""
    leaf = key[0].as_py()
    table = table.combine_chunks()
    ids, side, copies = (table[c].to_numpy() for c in ("id", "side", "copies"))
    x, _ = _matrix(table["v"].chunk(0), dim)
    linked = (x @ x.T) >= cosine
    np.fill_diagonal(linked, False)
    core = table["core"].to_numpy()
    linked &= core[:, None] | core[None, :]      # a pair of a ball has a core member; all are, in a leaf
    if key[1].as_py() != key[2].as_py():
        linked &= side[:, None] != side[None, :]
    label, links = ids.copy(), np.zeros(len(ids), np.int64)
    some = np.flatnonzero(linked.any(axis=1))
    if len(some):
        near = linked[np.ix_(some, some)]
        own, far = ids[some], np.iinfo(np.int64).max
        low = own
        while True:
            nxt = np.minimum(low, np.where(near, low[None, :], far).min(axis=1))
            if (nxt == low).all():
                break
            low = nxt
        label[some] = low
        # a pair counts here unless the two share an earlier leaf
        lists = table["leaves"].chunk(0).take(pa.array(some))
        rows = np.repeat(np.arange(len(some)), np.diff(lists.offsets.to_numpy()))
        code = lists.flatten().to_numpy()
        rows, code = rows[code < leaf], code[code < leaf]
        seen, col = np.unique(code, return_inverse=True)
        inside = np.zeros((len(some), len(seen)), np.float32)
        inside[rows, col] = 1
        fresh = near & (inside @ inside.T == 0)
        links[some] = fresh @ copies[some]
    return pa.table({"id": ids, "local": label, "links": links})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                 trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE,
                 block: int = BLOCK, dense: int = DENSE, seed: int = SEED) -> DataFrame:
    """``(id, n_links, component_id, kept)`` per row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite parts link with
    nothing (0 links, component themselves, kept).  Rows that repeat an id count
    as vectors of their own, in one component; null ids give a null component and
    are not kept.  An empty table gives an empty result; other columns are not
    read."""
    spark = vectors.sparkSession
    ship_package(spark)
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    # a hash passes over null parts: vectors with any have no class
    whole = F.when(~F.exists("v", lambda a: a.isNull()), F.col("v"))
    rows = rows.withColumns({"h1": F.when(whole.isNotNull(), F.xxhash64(F.lit(1), "v", F.size("v"))),
                             "h2": F.xxhash64(F.lit(2), "v", F.size("v"))})
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    classes = stored(rows.where("id is not null and h1 is not null and size(v) > 0").groupBy("h1", "h2")
                     .agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("v").alias("v")), "vectors")
    picked = classes.orderBy("h1").limit(sample).select("v").toArrow()["v"].combine_chunks()
    if isinstance(picked, pa.ChunkedArray):
        picked = picked.chunk(0) if picked.num_chunks else pa.array([], pa.list_(pa.float64()))
    x, good = _matrix(picked, dim)
    x = x[good]
    balls, free = find_balls(x, cosine, dense, seed)
    centres = spark.sparkContext.broadcast(balls)
    # one leaf a tree if no sample point is left
    forest = spark.sparkContext.broadcast(fit_forest(x[free], trees, leaf, spill, seed) if good.any() else [])

    routed = stored(arrow_map(classes.select("id", "copies", "v"), lambda it: _route(it, dim, forest, centres, cosine),
                              f"id long, copies long, v {kind}, leaves array<int>, balls array<int>"), "routed")
    # members of each leaf and ball; blocks of a large one, those of tight members last
    places = F.concat(
        F.transform("leaves", lambda c: F.struct(c.alias("leaf"), F.lit(True).alias("core"), F.lit(False).alias("tight"))),
        F.transform("balls", lambda c: F.struct((F.shiftright(c, 2) + F.lit(trees << 24)).alias("leaf"),
                                                (c.bitwiseAND(F.lit(2)) != 0).alias("core"), (c.bitwiseAND(F.lit(1)) != 0).alias("tight"))))
    members = routed.select("id", "copies", "v", "leaves", F.explode(places).alias("at")).select("id", "copies", "v", "leaves", "at.*")
    # a row per leaf and ball: bounded by the sample, as trees stop at ``leaf`` sample points
    blocks = lambda tight: F.ceil(F.count(F.when(F.col("tight") == tight, 1)) / block).cast("int")     # noqa: E731
    sizes = members.groupBy("leaf").agg(
        blocks(False).alias("loose"), blocks(True).alias("close"), F.min(F.when(F.col("tight"), F.col("id"))).alias("first"),
        F.sum(F.when(F.col("tight"), F.col("copies"))).alias("all"))
    sizes = stored(sizes, "sizes")
    placed = members.join(F.broadcast(sizes), "leaf").withColumn("own", F.when(
        F.col("tight"), F.col("loose") + F.pmod(F.xxhash64("id"), "close")).otherwise(F.pmod(F.xxhash64("id"), "loose")).cast("int"))
    # tight members meet the loose ones only
    last = F.when(F.col("tight"), F.col("loose")).otherwise(F.col("loose") + F.col("close")) - 1
    pairs = (placed.withColumn("other", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
             .select("leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     F.col("own").alias("side"), "core", "id", "copies", "v", "leaves"))
    compared = pairs.groupBy("leaf", "i", "j").applyInArrow(
        lambda key, t: _compare(key, t, dim, cosine), "id long, local long, links long")
    counted = placed.where("tight").select("id", F.col("first").alias("local"), (F.col("all") - F.col("copies")).alias("links"))
    found = stored(compared.unionAll(counted), "found")

    comp = components(found.where("id <> local").select(F.col("id").alias("a"), F.col("local").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    member = (classes.select("h1", "h2", F.col("id").alias("rep"), "copies")
              .join(counts.select(F.col("id").alias("rep"), "links"), "rep")
              .join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
              .select("h1", "h2", (F.col("links") + F.col("copies") - 1).alias("n"),
                      F.coalesce("component", "rep").alias("c")))
    out = rows.select("id", "h1", "h2").join(member, ["h1", "h2"], "left").select(
        F.col("id").alias(id_col), F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def op3_projection_forest(spark, sf_dir):
    """Near-duplicate classes of all embeddings, cosine >= 0.9."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
