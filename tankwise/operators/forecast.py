"""Consumption forecasting with Spark ML (FT3, FT4, SC12, ML1-ML3, SNK3).

One regressor per equipment type (as the reference), each a distributed
Spark ML fit over the cached-on-disk feature matrix; the driver loop only
sequences a handful of jobs (types are few).  Forecasts are a grid
(latest row x horizon) scored with one ``transform`` per type.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankwise.functions import scalar as S
from tankwise.operators.joins import join_checked, materialize_small
from tankwise.operators.sequence import latest_by

# Fixed declared feature list and type vocabulary (target excluded: defect Q1 fixed).
TYPE_LEVELS = ["Bulldozer", "Excavator", "Forklift", "Loader", "Truck"]
BASE_FEATURES = ["hour", "weekday", "is_weekend", "load_pct", "rpm", "speed", "ambient_temp",
                 *[f"equipment_type_{t.lower()}" for t in TYPE_LEVELS], "operational_status_running"]
OPTIONAL_FEATURES = ["avg_load_12h", "avg_speed_12h", "avg_consumption_12h", "engine_temp",
                     "maintenance_status_normal"]
MODEL_FEATURES = BASE_FEATURES + OPTIONAL_FEATURES
TARGET = "fuel_consumed"
MIN_TRAIN_ROWS = 100


def model_matrix(features: DataFrame, keep=()) -> DataFrame:
    """FT3/SC12/PRJ5/PRJ14: declared numeric features with a fixed vocabulary
    (absent level -> 0, unseen level -> no column), NULL -> 0."""
    cols = {f"equipment_type_{t.lower()}": (F.col("equipment_type") == t).cast("int") for t in TYPE_LEVELS}
    cols["operational_status_running"] = (F.col("operational_status") == "Running").cast("int")
    cols["maintenance_status_normal"] = (F.col("maintenance_status") == "Normal").cast("int")
    d = features.withColumns(cols)
    sel = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in d.columns else F.lit(0.0).alias(c)
           for c in MODEL_FEATURES]
    label = F.col(TARGET) if TARGET in d.columns else F.lit(None).cast("double")
    return d.select("event_id", "equipment_id", "equipment_type", "ts", *keep, label.alias("label"), *sel)


def standardize(df: DataFrame, cols, group: str = "equipment_type") -> DataFrame:
    """FT4: per-group (x - mean) / population std (sklearn's scaler; zero std
    -> scale 1).  Statistics are one grouped aggregate joined back."""
    stats = df.groupBy(group).agg(*[F.avg(c).alias(f"_mu_{c}") for c in cols],
                                  *[F.stddev_pop(c).alias(f"_sd_{c}") for c in cols])
    j = join_checked(df, stats, group, "inner")
    scaled = {}
    for c in cols:
        sd = F.col(f"_sd_{c}")
        scaled[c] = (F.col(c) - F.col(f"_mu_{c}")) / F.when(sd > 0, sd).otherwise(F.lit(1.0))
    return j.withColumns(scaled).drop(*[f"_mu_{c}" for c in cols], *[f"_sd_{c}" for c in cols])


def _estimator(kind: str, trees: int, seed: int):
    if kind == "rf":
        return RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=trees, seed=seed)
    return GBTRegressor(featuresCol="features", labelCol="label", maxIter=trees, stepSize=0.1, seed=seed)


def train_per_type(matrix: DataFrame, kind: str = "rf", trees: int = 100, seed: int = 42,
                   min_rows: int = MIN_TRAIN_ROWS, parallelism: int = 4,
                   checkpoint: bool = True) -> dict[str, PipelineModel]:
    """ML1: one pipeline (assembler + regressor) per type with >= min_rows.

    The matrix is checkpointed once (shared folder) so each per-type fit
    reads materialised rows instead of recomputing the feature windows.  The
    fits are independent distributed jobs; up to ``parallelism`` of them are
    submitted concurrently from driver threads (as Spark ML's tuning does).
    """
    from concurrent.futures import ThreadPoolExecutor
    m = matrix.checkpoint(eager=True) if checkpoint else matrix
    counts = materialize_small(m.groupBy("equipment_type").count())
    types = sorted(r["equipment_type"] for r in counts.filter(F.col("count") >= min_rows).collect()
                   if r["equipment_type"] is not None)

    def fit(t):
        pipe = Pipeline(stages=[VectorAssembler(inputCols=MODEL_FEATURES, outputCol="features",
                                                handleInvalid="keep"),
                                _estimator(kind, trees, seed)])
        return t, pipe.fit(m.filter(F.col("equipment_type") == t))

    if not types:
        return {}
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(types)))) as pool:
        return dict(pool.map(fit, types))


def score_per_type(df: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """Apply each type's model to its rows; types without a model are dropped (JN9),
    so without any model the result is empty."""
    out = df.where(F.lit(False)).withColumn("prediction", F.lit(None).cast("double"))
    for t, mdl in models.items():
        out = out.unionByName(mdl.transform(df.filter(F.col("equipment_type") == t)).drop("features"))
    return out


def importances(models: dict[str, PipelineModel], spark) -> DataFrame:
    """ML2: feature importances per type as rows (model metadata, bounded)."""
    rows = []
    for t, mdl in models.items():
        imp = mdl.stages[-1].featureImportances.toArray()
        rows += [(t, f, float(v)) for f, v in zip(MODEL_FEATURES, imp)]
    return spark.createDataFrame(rows, "equipment_type string, feature string, importance double")


def forecast_grid(features: DataFrame, horizon: int = 24) -> DataFrame:
    """JN10: latest row per unit x hours 1..H; calendar recomputed for each
    future hour, other covariates held (persistence assumption)."""
    return _future_hours(latest_by(features, method="sort"), horizon)   # features come from window pipelines: one pass


def _future_hours(latest: DataFrame, horizon: int) -> DataFrame:
    g = latest.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    fts = F.col("ts") + F.make_dt_interval(F.lit(0), F.col("h"))
    g = g.withColumn("forecast_ts", fts)
    return g.withColumns({"hour": F.hour("forecast_ts").cast("int"),
                          "weekday": S.weekday_mon0(F.col("forecast_ts")),
                          "is_weekend": (S.weekday_mon0(F.col("forecast_ts")) >= 5).cast("int")})


def grid_of_matrix(matrix: DataFrame, horizon: int = 24) -> DataFrame:
    """JN10 from a stored model matrix: the same rows as ``model_matrix`` of
    ``forecast_grid``, without computing the windows of all history again.  The latest
    rows, one per unit, are stored once, as every type's model reads them."""
    latest = materialize_small(latest_by(matrix))
    future = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("hour", "weekday", "is_weekend")}
    return _future_hours(latest, horizon).withColumns(future).select(
        "event_id", "equipment_id", "equipment_type", "ts", "h", "forecast_ts", "label", *MODEL_FEATURES)


def forecast(grid_matrix: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """ML3: predictions on the grid, clipped at 0."""
    s = score_per_type(grid_matrix, models)
    return s.withColumn("predicted_consumption", F.greatest(F.lit(0.0), F.col("prediction")))


def schema_drift(train: DataFrame, predict: DataFrame) -> dict[str, list[str]]:
    """SE4: column-name set difference between training and prediction
    frames (metadata only, no job)."""
    a, b = set(train.columns), set(predict.columns)
    return {"missing": sorted(a - b), "extra": sorted(b - a)}


def align_to_training(predict: DataFrame, train_columns) -> DataFrame:
    """SC12 at prediction time: absent training columns -> 0, unseen columns dropped."""
    have = set(predict.columns)
    return predict.select(*[F.col(c) if c in have else F.lit(0.0).alias(c) for c in train_columns])
