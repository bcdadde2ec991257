"""Isolation forest (Liu, Ting & Zhou, 2008) on Spark (ML4, ML5, ML7).

Spark ML has no isolation forest, so:

* training draws, per equipment type, ``trees`` samples of ``psi`` rows with
  hash-based Bernoulli selection (rows are replicated when a type has fewer
  than trees*psi rows, so every tree still sees ~psi distinct rows); each
  (type, tree) group -- bounded by construction -- builds one tree in NumPy
  via ``applyInPandas``;
* the node table (types x trees x <= 2^(h+1)-1 nodes) is counted, then
  broadcast, and ``mapInArrow`` scores every row in vectorised passes;
* the cut-off is the (1 - contamination) quantile of the training scores per
  type (``percentile_approx``, a partial aggregate).
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankwise.operators.forecast import standardize
from tankwise.operators.joins import join_checked, materialize_small
from tankwise.operators.models import Model, ModelRegistry

# Fixed feature lists of the anomaly detector (base + optional when present).
BASE = ["fuel_consumed", "load_pct", "rpm", "speed", "idle_time", "ambient_temp", "engine_temp",
        "oil_pressure", "fuel_efficiency", "emission_rate"]
OPTIONAL = ["fuel_level_change", "engine_ambient_temp_diff", "consumption_per_load", "battery_voltage",
            "throttle"]
EULER = 0.5772156649015329
PACKED_NODES = 2_000_000   # model nodes sent to the tasks at a time (about 100 MB)

NODE_SCHEMA = ("equipment_type string, tree int, node int, feature int, threshold double, "
               "left int, right int, size int, depth int, psi int")


def feature_columns(df: DataFrame):
    return BASE + [c for c in OPTIONAL if c in df.columns]


def raw_matrix(features: DataFrame, cols=None, carry=()) -> DataFrame:
    """FT2/PRJ14: finite, non-null features as they are; ``carry`` columns go along."""
    cols = cols or feature_columns(features)
    clean = {}
    for c in cols:
        v = F.col(c).cast("double")
        clean[c] = F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(0.0)).otherwise(
            F.coalesce(v, F.lit(0.0)))
    return features.select("event_id", "equipment_id", "equipment_type", "ts", *carry, *[clean[c].alias(c) for c in cols])


def anomaly_matrix(features: DataFrame, cols=None, carry=()) -> DataFrame:
    """FT2/PRJ14/FT4: ``raw_matrix`` standardised per type."""
    cols = cols or feature_columns(features)
    return standardize(raw_matrix(features, cols, carry), cols)


def scalers(matrix: DataFrame, cols) -> DataFrame:
    """Per-type mean and population deviation of the raw features, one row per
    (type, feature)."""
    agg = matrix.where("equipment_type is not null").groupBy("equipment_type").agg(
        *[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in cols])
    return agg.select("equipment_type", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c)["mean"].alias("mean"), F.col(c)["std"].alias("std")) for c in cols])
    ).alias("s")).select("equipment_type", "s.*")


def scaled(raw: DataFrame, saved: DataFrame, cols) -> DataFrame:
    """Raw rows standardised by saved scalers (no spread: scale 1); types that the
    scalers do not know are dropped (JN9)."""
    of = lambda c, v: F.max(F.when(F.col("feature") == c, F.col(v)))      # noqa: E731
    wide = saved.groupBy("equipment_type").agg(*[of(c, "mean").alias(f"_mu_{c}") for c in cols], *[of(c, "std").alias(f"_sd_{c}") for c in cols])
    j = join_checked(raw, wide, "equipment_type", "inner")
    out = {c: (F.col(c) - F.col(f"_mu_{c}")) / F.when(F.col(f"_sd_{c}") > 0, F.col(f"_sd_{c}")).otherwise(F.lit(1.0)) for c in cols}
    return j.withColumns(out).drop(*[f"_mu_{c}" for c in cols], *[f"_sd_{c}" for c in cols])


def c_factor(n):
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _build(pdf: pd.DataFrame, cols, psi: int, seed: int) -> pd.DataFrame:
    etype = pdf["equipment_type"].iloc[0]
    tree = int(pdf["tree"].iloc[0])
    pdf = pdf.drop_duplicates("event_id").sort_values("_h")
    x = pdf[cols].to_numpy(dtype=float)[:psi]
    n_used = len(x)
    rng = np.random.default_rng([seed, tree, zlib.crc32(str(etype).encode())])
    limit = int(math.ceil(math.log2(max(psi, 2))))
    rows = []
    stack = [(np.arange(n_used), 0, 0)]
    next_id = 1
    while stack:
        idx, depth, nid = stack.pop()
        sub = x[idx]
        if depth >= limit or len(idx) <= 1:
            rows.append((nid, -1, 0.0, -1, -1, len(idx), depth))
            continue
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            rows.append((nid, -1, 0.0, -1, -1, len(idx), depth))
            continue
        q = int(rng.choice(usable))
        p = float(rng.uniform(lo[q], hi[q]))
        left_mask = sub[:, q] < p
        lid, rid = next_id, next_id + 1
        next_id += 2
        rows.append((nid, q, p, lid, rid, len(idx), depth))
        stack.append((idx[left_mask], depth + 1, lid))
        stack.append((idx[~left_mask], depth + 1, rid))
    out = pd.DataFrame(rows, columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
    out.insert(0, "tree", tree)
    out.insert(0, "equipment_type", etype)
    out["psi"] = n_used
    return out


def train(matrix: DataFrame, trees: int = 100, psi: int = 256, seed: int = 42, cols=None,
          min_rows: int = 50) -> DataFrame:
    """ML4: node table of a forest per type (types with >= min_rows rows)."""
    cols = cols or [c for c in feature_columns(matrix) if c in matrix.columns]
    counts = matrix.groupBy("equipment_type").agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") >= min_rows)
    # Expected copies per row so that each tree receives ~1.25 psi rows.
    counts = counts.withColumn("_rate", F.lit(trees * psi * 1.25) / F.col("_n"))
    d = join_checked(matrix, counts, "equipment_type", "inner")
    copies = F.greatest(F.lit(1), F.ceil(F.col("_rate"))).cast("int")
    d = d.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("event_id"), F.col("_copy")), F.lit(1 << 30))
         / F.lit(float(1 << 30)))
    keep = u < F.col("_rate") / copies
    d = d.filter(keep).withColumns({
        "tree": F.pmod(F.xxhash64(F.lit(seed + 1), F.col("event_id"), F.col("_copy")), F.lit(trees)).cast("int"),
        "_h": F.xxhash64(F.lit(seed + 2), F.col("event_id"), F.col("_copy")),
    })
    d = d.select("equipment_type", "tree", "event_id", "_h", *cols)
    return d.groupBy("equipment_type", "tree").applyInPandas(
        lambda pdf: _build(pdf, cols, psi, seed), NODE_SCHEMA)


def _pack(nodes: pd.DataFrame):
    """Node rows -> per type and tree ``(features, thresholds, leaves)`` by level: a
    level's arrays have a place for each node of a full tree, a leaf above the last
    level sends all rows on to the right; ``leaves`` holds the path lengths."""
    model = {}
    for t, g in nodes.groupby("equipment_type"):
        n_trees = int(g["tree"].max()) + 1
        trees = [_levels(x) for _, x in sorted(g.groupby("tree"))]
        psi_used = g.groupby("tree")["psi"].max().reindex(range(n_trees)).fillna(1).to_numpy()
        model[t] = (trees, n_trees, float(np.mean(psi_used)))
    return model


def _levels(g: pd.DataFrame):
    at = np.full(int(g["node"].max()) + 1, -1)
    at[g["node"].to_numpy()] = np.arange(len(g))
    feat, left, right = (g[c].to_numpy(np.int64) for c in ("feature", "left", "right"))
    thr = g["threshold"].to_numpy()
    length = g["depth"].to_numpy() + c_factor(g["size"].to_numpy())
    here, levels = at[[0]], []
    while (feat[here] >= 0).any():
        inner = feat[here] >= 0
        levels.append((np.where(inner, feat[here], 0), np.where(inner, thr[here], -np.inf)))
        low = np.where(inner, at[np.where(inner, left[here], 0)], here)
        high = np.where(inner, at[np.where(inner, right[here], 0)], here)
        here = np.stack([low, high], axis=1).ravel()
    return levels, length[here]


SCORED_ROWS = 4096       # rows that go down a tree together: their features stay in the processor's cache


def _score_matrix(x: np.ndarray, m) -> np.ndarray:
    """Scores of the rows of ``x`` (features, rows)."""
    trees, n_trees, mean_psi = m
    n = x.shape[1]
    total = np.zeros(n)
    for a in range(0, n, SCORED_ROWS):
        part = np.ascontiguousarray(x[:, a:a + SCORED_ROWS])
        k = part.shape[1]
        flat, rows = part.ravel(), np.arange(k)
        place, value, bound, less = np.empty(k, np.int64), np.empty(k), np.empty(k), np.empty(k, bool)
        for levels, length in trees:
            node = np.zeros(k, np.int64)
            for i, (feat, thr) in enumerate(levels):
                if i == 0:
                    np.less(part[feat[0]], thr[0], out=less)
                else:
                    np.take(feat * k, node, out=place, mode="clip")
                    np.add(place, rows, out=place)
                    np.take(flat, place, out=value, mode="clip")
                    np.take(thr, node, out=bound, mode="clip")
                    np.less(value, bound, out=less)
                node += node
                node += 1
                node -= less
            total[a:a + k] += length[node]
    return np.power(2.0, -(total / n_trees) / max(float(c_factor([mean_psi])[0]), 1e-12))


def score(matrix: DataFrame, nodes: DataFrame, cols=None) -> DataFrame:
    """ML5: anomaly score in (0, 1] per row (higher = more isolated), beside the
    row's other columns: nothing is joined back, so resent rows stay as they are.

    The model goes to the tasks in packs of whole types of at most PACKED_NODES
    nodes (one type has at most trees x 2 psi); each pack scores the rows of its
    types.  Rows of types without a model are scored NULL."""
    cols = cols or [c for c in feature_columns(matrix) if c in matrix.columns]
    if not cols:
        raise ValueError("no feature columns to score")
    nodes = materialize_small(nodes)
    packs, size = [[]], 0
    for r in nodes.groupBy("equipment_type").count().orderBy("equipment_type").collect():    # one row per type
        if size + r["count"] > PACKED_NODES and packs[-1]:
            packs.append([])
            size = 0
        packs[-1].append(r["equipment_type"])
        size += r["count"]
    keep = [c for c in matrix.columns if c not in cols]
    schema = T.StructType([matrix.schema[c] for c in keep] + [T.StructField("iso_score", T.DoubleType())])
    spark = matrix.sparkSession
    out = None
    for i, types in enumerate(packs):
        model = spark.sparkContext.broadcast(_pack(nodes.where(F.col("equipment_type").isin(types)).toPandas()))
        mine = F.col("equipment_type").isin(types)
        # rows of other types go with the first pack; a single pack has all rows in one pass
        others = [t for p in packs[1:] for t in p]
        rows = matrix.where(mine) if i else matrix.where(F.coalesce(~F.col("equipment_type").isin(others), F.lit(True))) if others else matrix
        rows = rows.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols]).mapInArrow(_scorer(model, cols, keep), schema)
        out = rows if out is None else out.unionAll(rows)
    return out


def _scorer(model, cols, keep):
    def run(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            kinds = columns["equipment_type"].dictionary_encode()
            code = kinds.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            x = np.stack([columns[c].to_numpy(zero_copy_only=False) for c in cols])
            out, known = np.zeros(len(batch)), np.zeros(len(batch), bool)
            for i, t in enumerate(kinds.dictionary.to_pylist()):
                if t in model.value:
                    of = np.flatnonzero(code == i)
                    out[of], known[of] = _score_matrix(x[:, of], model.value[t]), True
            yield pa.record_batch([*[columns[c] for c in keep], pa.array(out, mask=~known)], names=[*keep, "iso_score"])
    return run


def cutoffs(train_scores: DataFrame, contamination: float = 0.05) -> DataFrame:
    """Per-type threshold: the (1 - contamination) quantile of training scores."""
    return train_scores.groupBy("equipment_type").agg(
        F.percentile_approx("iso_score", 1.0 - contamination, 10000).alias("iso_cut"))


def detect(matrix: DataFrame, nodes: DataFrame, train_flag: str | None = None,
           contamination: float = 0.05, cols=None) -> DataFrame:
    """ML5: scores + flag ``iso_score > cut``; the cut comes from the rows whose
    boolean column ``train_flag`` is set (default: all)."""
    s = score(matrix, nodes, cols)
    cuts = cutoffs(s if train_flag is None else s.where(train_flag), contamination)
    s = join_checked(s, cuts, "equipment_type", "inner")
    return s.withColumn("iso_anomaly", F.col("iso_score") > F.col("iso_cut"))


def combined(df: DataFrame) -> DataFrame:
    """ML7: either detector fires; report which.  Both flags stand on the same row."""
    iso_f = F.coalesce(F.col("iso_anomaly"), F.lit(False))
    st_f = F.coalesce(F.col("stat_anomaly"), F.lit(False))
    return df.withColumns({
        "anomaly_detected": iso_f | st_f,
        "detectors": F.concat_ws(",", F.when(iso_f, F.lit("isolation_forest")), F.when(st_f, F.lit("statistical"))),
    })


@dataclass
class Forest:
    """What scoring needs: trees, scalers and cut-offs per type, features in order."""
    nodes: DataFrame
    scalers: DataFrame
    cutoffs: DataFrame
    features: list[str]


def fit_forest(raw: DataFrame, train_flag: str, cols, trees: int = 100, psi: int = 256, seed: int = 42,
               contamination: float = 0.05) -> Forest:
    """ML4: scalers of all rows, trees and cut-offs of the rows whose ``train_flag`` is set."""
    saved = materialize_small(scalers(raw, cols))
    rows = scaled(raw, saved, cols).where(train_flag)
    nodes = materialize_small(train(rows, trees, psi, seed, cols))
    return Forest(nodes, saved, materialize_small(cutoffs(score(rows, nodes, cols), contamination)), list(cols))


def detect_with(raw: DataFrame, forest: Forest) -> DataFrame:
    """ML5 by a fitted or loaded forest: raw rows are scaled, scored and held against
    their type's cut-off; types that it does not know are dropped."""
    s = score(scaled(raw, forest.scalers, forest.features), forest.nodes, forest.features)
    s = join_checked(s, forest.cutoffs, "equipment_type", "inner")
    return s.withColumn("iso_anomaly", F.col("iso_score") > F.col("iso_cut"))


def save_forest(registry: ModelRegistry, source: str, settings: dict, forest: Forest) -> Forest:
    """SNK3: a version of trees, scalers, cut-offs and feature list; as loaded again."""
    tables = {"nodes": forest.nodes, "scalers": forest.scalers, "cutoffs": forest.cutoffs}
    return _as_forest(registry.publish("forest", source, settings, forest.features, tables))


def find_forest(registry: ModelRegistry, source: str, settings: dict, features=None) -> Forest | None:
    found = registry.find("forest", source, settings, features)
    return None if found is None else _as_forest(found)


def _as_forest(model: Model) -> Forest:
    return Forest(model.tables["nodes"], model.tables["scalers"], model.tables["cutoffs"], model.features)
