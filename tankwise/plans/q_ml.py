"""Registered jobs: forecasting and isolation forest (build steps 9-10).

Matrices, scaling and the forecast grid are SQL-expressible and carry DuckDB
oracles; fitted models are checked by row counts here and by the unit tests
(determinism, error below the mean predictor, ~5 % flagged).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tankwise.functions import scalar as S
from tankwise.llm.shared import dropped, stored
from tankwise.operators import anomaly as A
from tankwise.operators import features as FE
from tankwise.operators import forecast as FC
from tankwise.operators import isolation as ISO
from tankwise.operators.joins import join_checked
from tankwise.operators.models import ModelRegistry
from tankwise.operators.sequence import ordered_split
from tankwise.plans.q_features import CAL_SQL, FLAG_SQL, ROLL_SQL
from tankwise.plans.registry import register, rnd, with_t
from tankwise.session import ensure_checkpoint_dir, scratch_path
from tankwise.sources.tables import telemetry
from tankwise.sources.versions import fingerprint

TREES = 100        # as the reference
FOREST = {"trees": 100, "psi": 256, "seed": 42, "contamination": 0.05}


def _matrix_cols_sql() -> dict:
    d = {"hour": CAL_SQL["hour"], "weekday": CAL_SQL["weekday"], "is_weekend": CAL_SQL["is_weekend"],
         "load_pct": "load_pct", "rpm": "rpm", "speed": "speed", "ambient_temp": "ambient_temp"}
    for t in FC.TYPE_LEVELS:
        d[f"equipment_type_{t.lower()}"] = f"CAST(coalesce(CAST(equipment_type = '{t}' AS INTEGER), 0) AS DOUBLE)"
    d["operational_status_running"] = "CAST(coalesce(CAST(operational_status = 'Running' AS INTEGER), 0) AS DOUBLE)"
    d["avg_load_12h"] = ROLL_SQL["avg_load_12h"]
    d["avg_speed_12h"] = ROLL_SQL["avg_speed_12h"]
    d["avg_consumption_12h"] = ROLL_SQL["avg_consumption_12h"]
    d["engine_temp"] = "engine_temp"
    d["maintenance_status_normal"] = "CAST(coalesce(CAST(maintenance_status = 'Normal' AS INTEGER), 0) AS DOUBLE)"
    return {k: f"coalesce(CAST({v} AS DOUBLE), 0e0)" for k, v in d.items()}


MATRIX_COLS = _matrix_cols_sql()
MATRIX_CTE = ("mx AS (SELECT event_id, equipment_id, equipment_type, ts, fuel_consumed AS label, "
              + ", ".join(f"{v} AS {k}" for k, v in MATRIX_COLS.items()) + " FROM t)")


def _features(spark, sf_dir):
    return FE.features_all(telemetry(spark, sf_dir), onehot=False)


def _matrix(spark, sf_dir):
    return FC.model_matrix(_features(spark, sf_dir))


@register("features_model_matrix", rnd(with_t("SELECT * FROM mx", MATRIX_CTE), ["label", *FC.MODEL_FEATURES]))
def features_model_matrix(spark, sf_dir):
    """FT3/SC12/PRJ5: declared regression features, fixed vocabulary, target apart."""
    return _matrix(spark, sf_dir)


def _scaled_sql(src: str, cols) -> str:
    parts = []
    for c in cols:
        w = "OVER (PARTITION BY equipment_type)"
        parts.append(f"({c} - avg({c}) {w}) / CASE WHEN stddev_pop({c}) {w} > 0 THEN stddev_pop({c}) {w} "
                     f"ELSE 1e0 END AS {c}")
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM {src}"


@register("scaled_features", rnd(with_t(_scaled_sql("mx", FC.MODEL_FEATURES), MATRIX_CTE),
                                 ["label", *FC.MODEL_FEATURES]))
def scaled_features(spark, sf_dir):
    """FT4: per-type standard scaling with population std (zero std -> 1)."""
    return FC.standardize(_matrix(spark, sf_dir), FC.MODEL_FEATURES)


ANOM_RAW = {c: c for c in ISO.BASE}
ANOM_RAW.update({
    "fuel_level_change": "coalesce(fuel_level - lag(fuel_level) OVER (PARTITION BY equipment_id ORDER BY ts, event_id), 0e0)",
    "engine_ambient_temp_diff": FLAG_SQL["engine_ambient_temp_diff"],
    "consumption_per_load": FLAG_SQL["consumption_per_load"],
    "battery_voltage": "battery_voltage", "throttle": "throttle"})
ANOM_COLS = ISO.BASE + ISO.OPTIONAL
AMX_CTE = ("amx AS (SELECT event_id, equipment_id, equipment_type, ts, "
           + ", ".join(f"coalesce(CASE WHEN isnan(CAST({v} AS DOUBLE)) OR isinf(CAST({v} AS DOUBLE)) THEN 0e0 "
                       f"ELSE CAST({v} AS DOUBLE) END, 0e0) AS {k}" for k, v in ANOM_RAW.items())
           + " FROM t)")


def _anomaly_matrix(spark, sf_dir):
    return ISO.anomaly_matrix(_features(spark, sf_dir))


@register("anomaly_matrix", rnd(with_t(_scaled_sql("amx", ANOM_COLS), AMX_CTE), ANOM_COLS))
def anomaly_matrix(spark, sf_dir):
    """FT2/FT4: 15 anomaly features, finite, standardised per type."""
    return _anomaly_matrix(spark, sf_dir)


GRID_CTE = (f"latest_mx AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY equipment_id "
            f"ORDER BY ts DESC, event_id DESC) AS rn FROM mx) WHERE rn = 1), "
            f"grid AS (SELECT l.* REPLACE ({CAL_SQL['hour'].replace('ts', 'forecast_ts')} AS hour, "
            f"{CAL_SQL['weekday'].replace('ts', 'forecast_ts')} AS weekday, "
            f"{CAL_SQL['is_weekend'].replace('ts', 'forecast_ts')} AS is_weekend), h, forecast_ts FROM "
            f"(SELECT l.*, CAST(g.h AS INTEGER) AS h, l.ts + to_hours(g.h) AS forecast_ts "
            f"FROM latest_mx l CROSS JOIN range(1, 25) g(h)) l)")


def _grid(spark, sf_dir):
    feats = _features(spark, sf_dir)
    grid = FC.forecast_grid(feats, 24)
    return FC.model_matrix(grid, keep=("h", "forecast_ts"))


@register("forecast_grid", rnd(with_t(
    "SELECT event_id, equipment_id, equipment_type, ts, h, forecast_ts, "
    + ", ".join(FC.MODEL_FEATURES) + " FROM grid", MATRIX_CTE, GRID_CTE), FC.MODEL_FEATURES))
def forecast_grid(spark, sf_dir):
    """JN10: latest row x 24 future hours, calendar recomputed, covariates held."""
    return _grid(spark, sf_dir).select("event_id", "equipment_id", "equipment_type", "ts", "h", "forecast_ts",
                                       *FC.MODEL_FEATURES)


def registry(spark, sf_dir) -> ModelRegistry:
    """Models of a table folder, in the shared folder."""
    name = hashlib.sha256(sf_dir.rstrip("/").encode()).hexdigest()[:24]
    return ModelRegistry(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tankwise/models/{name}")


def source(spark, sf_dir) -> str:
    return fingerprint(spark, f"{sf_dir.rstrip('/')}/events.parquet")


def _settings(kind) -> dict:
    return {"kind": kind, "trees": TREES, "share": 0.8, "min_rows": FC.MIN_TRAIN_ROWS, "seed": 42}


def _train(spark, sf_dir, kind="rf"):
    """Trains per type on the ordered 80 % and publishes models and matrix as a version."""
    made_from, models_of = source(spark, sf_dir), registry(spark, sf_dir)
    features = stored(_matrix(spark, sf_dir), "matrix")       # the split reads its rows several times, the windows run once
    mx = models_of.stage(f"consumption-{kind}", ordered_split(features, 0.8), "equipment_type")   # each fit reads its own type
    dropped(features)
    models = FC.train_per_type(mx.filter("is_train").drop("is_train"), kind=kind, trees=TREES, checkpoint=False)
    made = models_of.publish(f"consumption-{kind}", made_from, _settings(kind), FC.MODEL_FEATURES, {"matrix": mx}, models)
    return made.tables["matrix"], made.pipelines


def _trained(spark, sf_dir, kind="rf"):
    """The newest published models of this state of the table, else newly trained ones."""
    found = registry(spark, sf_dir).find(f"consumption-{kind}", source(spark, sf_dir), _settings(kind), FC.MODEL_FEATURES)
    return (found.tables["matrix"], found.pipelines) if found else _train(spark, sf_dir, kind)


def _rmse(mx, models):
    scored = FC.score_per_type(mx, models)
    means = mx.filter("is_train").groupBy("equipment_type").agg(F.avg("label").alias("_mean"))
    s = join_checked(scored, means, "equipment_type", "inner")   # per-type table, counted
    return s.groupBy("equipment_type", "is_train").agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.sqrt(F.avg((F.col("prediction") - F.col("label")) ** 2)).alias("rmse"),
        F.sqrt(F.avg((F.col("_mean") - F.col("label")) ** 2)).alias("rmse_mean_predictor"))


@register("train_consumption")
def train_consumption(spark, sf_dir):
    """ML1: per-type regressors on the ordered 80 % split; RMSE vs mean predictor."""
    return _rmse(*_train(spark, sf_dir))


@register("train_boosted")
def train_boosted(spark, sf_dir):
    """ML1: the same with boosted trees."""
    return _rmse(*_train(spark, sf_dir, "gbt"))


# Counts of the ordered split per type: exact whatever the models are.
SPLIT_SQL = """SELECT equipment_type, pos <= floor(total * 0.8) AS is_train, count(*) AS n
FROM (SELECT equipment_type, row_number() OVER (ORDER BY equipment_id, ts, event_id) AS pos, count(*) OVER () AS total FROM mx)
GROUP BY ALL"""


@register("training_rows", with_t(SPLIT_SQL, MATRIX_CTE))
def training_rows(spark, sf_dir):
    """ML1: rows per type and side of the split that the models were trained and scored on."""
    mx, models = _trained(spark, sf_dir)
    return FC.score_per_type(mx, models).groupBy("equipment_type", "is_train").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("feature_importance")
def feature_importance(spark, sf_dir):
    """ML2: feature importances per type."""
    return FC.importances(_trained(spark, sf_dir)[1], spark)


@register("importance_sums", with_t(f"""
SELECT equipment_type, CAST({len(FC.MODEL_FEATURES)} AS BIGINT) AS features, 1e0 AS total
FROM mx GROUP BY equipment_type""", MATRIX_CTE))
def importance_sums(spark, sf_dir):
    """ML2: every type has an importance for every feature; they add up to one."""
    return FC.importances(_trained(spark, sf_dir)[1], spark).groupBy("equipment_type").agg(
        F.count("*").alias("features"), F.sum("importance").alias("total"))


def _forecasts(spark, sf_dir):
    mx, models = _trained(spark, sf_dir)
    return FC.forecast(FC.grid_of_matrix(mx.drop("is_train")), models)


@register("forecast_consumption")
def forecast_consumption(spark, sf_dir):
    """ML3: next-24-hour consumption per unit, clipped at zero."""
    return _forecasts(spark, sf_dir).select("equipment_id", "equipment_type", "h", "forecast_ts",
                                            "predicted_consumption")


@register("forecast_hours", with_t("""
SELECT equipment_id, equipment_type, h, forecast_ts, true AS finite, false AS below_zero FROM grid""", MATRIX_CTE, GRID_CTE))
def forecast_hours(spark, sf_dir):
    """ML3: a finite forecast, clipped at zero, for each of the next 24 hours of every unit."""
    p = F.col("predicted_consumption")
    return _forecasts(spark, sf_dir).select("equipment_id", "equipment_type", "h", "forecast_ts",
                                            (p.isNotNull() & ~F.isnan(p)).alias("finite"), (p < 0).alias("below_zero"))


@register("forecast_times", with_t("""
SELECT equipment_id, equipment_type, h, CASE WHEN microsecond(forecast_ts) % 1000000 = 0 THEN strftime(forecast_ts, '%Y-%m-%dT%H:%M:%S')
  ELSE strftime(forecast_ts, '%Y-%m-%dT%H:%M:%S.%f') END AS served_at FROM grid""", MATRIX_CTE, GRID_CTE))
def forecast_times(spark, sf_dir):
    """VW3/SC26: the ordered items of every unit's forecast payload carry ISO times, hour by hour."""
    f = _forecasts(spark, sf_dir)
    items = F.sort_array(F.collect_list(F.struct("h", S.iso_text(S.plus_hours("ts", "h")).alias("served_at"))))
    return (f.groupBy("equipment_id", "equipment_type").agg(items.alias("items"))          # 24 items a unit
            .select("equipment_id", "equipment_type", F.explode("items").alias("i")).select("equipment_id", "equipment_type", "i.*"))


@register("forecast_payload")
def forecast_payload(spark, sf_dir):
    """VW3: per-unit forecast payload (ordered items, values rounded to 2)."""
    f = _forecasts(spark, sf_dir)
    items = F.sort_array(F.collect_list(F.struct("forecast_ts", S.half_even("predicted_consumption", 2).alias("p"))))
    g = f.groupBy("equipment_id", "equipment_type").agg(items.alias("items"))
    return g.select("equipment_id", "equipment_type", F.size("items").cast("long").alias("n_hours"),
                    F.col("items")[0]["forecast_ts"].alias("first_ts"),
                    F.element_at("items", -1)["forecast_ts"].alias("last_ts"),
                    F.aggregate("items", F.lit(0.0), lambda a, x: a + x["p"]).alias("total_predicted"), "items")


@register("model_roundtrip", with_t("""
SELECT equipment_type, count(*) AS n, 0e0 AS max_abs_diff FROM grid GROUP BY equipment_type""", MATRIX_CTE, GRID_CTE))
def model_roundtrip(spark, sf_dir):
    """SNK3: publish each type's pipeline, load that version, score the grid with both."""
    mx, models = _trained(spark, sf_dir)
    other = ModelRegistry(spark, scratch_path(spark, "models"))
    loaded = other.publish("copy", "", {}, FC.MODEL_FEATURES, pipelines=models).pipelines
    once = FC.score_per_type(FC.grid_of_matrix(mx.drop("is_train")), models).withColumnRenamed("prediction", "p1")
    both = FC.score_per_type(once, loaded)       # the same rows, scored again: no join
    return both.groupBy("equipment_type").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                              F.max(F.abs(F.col("p1") - F.col("prediction"))).alias("max_abs_diff"))


def _raw(spark, sf_dir):
    """Raw anomaly features with the training flag (no note) and the statistical flags
    on each row."""
    t = telemetry(spark, sf_dir)
    feats = A.detect_statistical(FE.features_all(t, onehot=False), A.sigma_thresholds(A.unannotated(t)), how="left")
    note = F.coalesce(F.length("event_notes"), F.lit(0)) == 0
    return ISO.raw_matrix(feats.withColumn("unannotated", note), ANOM_COLS,
                          carry=("unannotated", "stat_anomaly")).checkpoint(eager=True)


def _fit_forest(spark, sf_dir, raw):
    made_from = source(spark, sf_dir)
    forest = ISO.fit_forest(raw, "unannotated", ANOM_COLS, **FOREST)
    return forest, ISO.save_forest(registry(spark, sf_dir), made_from, FOREST, forest)


def _forest(spark, sf_dir, raw=None):
    """The newest published forest of this state of the table, else a newly fitted one."""
    found = ISO.find_forest(registry(spark, sf_dir), source(spark, sf_dir), FOREST, ANOM_COLS)
    return found or _fit_forest(spark, sf_dir, _raw(spark, sf_dir) if raw is None else raw)[1]


@register("forest_roundtrip", with_t("""
SELECT equipment_type, count(*) AS n, 0e0 AS max_abs_diff, CAST(0 AS BIGINT) AS flags_changed
FROM amx JOIN (SELECT equipment_type FROM t WHERE event_notes IS NULL OR event_notes = '' GROUP BY equipment_type HAVING count(*) >= 50)
  USING (equipment_type)
GROUP BY equipment_type""", AMX_CTE))
def forest_roundtrip(spark, sf_dir):
    """SNK3: fit the anomaly side (trees, scalers, cut-offs, features), publish it, load that
    version and score every reading with both."""
    raw = _raw(spark, sf_dir)
    fitted, loaded = _fit_forest(spark, sf_dir, raw)
    # the same rows, scored again: no join; each keeps its features beside the first score
    once = ISO.detect_with(raw.withColumn("_raw", F.struct(*ANOM_COLS)), fitted)
    once = once.select("equipment_type", F.col("iso_score").alias("s1"), F.col("iso_anomaly").alias("a1"), "_raw.*")
    both = ISO.detect_with(once, loaded)
    return both.where("s1 is not null").groupBy("equipment_type").agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.max(F.abs(F.col("iso_score") - F.col("s1"))).alias("max_abs_diff"),
        F.count_if(F.col("a1") != F.col("iso_anomaly")).cast("long").alias("flags_changed"))


@register("train_isolation")
def train_isolation(spark, sf_dir):
    """ML4: isolation-forest node table per type (100 trees, psi 256)."""
    return _fit_forest(spark, sf_dir, _raw(spark, sf_dir))[1].nodes


@register("isolation_shape", with_t("""
SELECT equipment_type, 100 AS trees, true AS leaves_hold_the_sample, true AS depth_bounded
FROM amx JOIN (SELECT DISTINCT equipment_type FROM t WHERE event_notes IS NULL OR event_notes = '') USING (equipment_type)
GROUP BY equipment_type HAVING count(*) >= 50""", AMX_CTE))
def isolation_shape(spark, sf_dir):
    """ML4: 100 trees per type; the leaves of each hold its whole sample, at most 256 rows."""
    nodes = _forest(spark, sf_dir).nodes
    tree = nodes.groupBy("equipment_type", "tree").agg(
        F.sum(F.when(F.col("feature") < 0, F.col("size"))).alias("leaves"), F.max("psi").alias("psi"), F.max("depth").alias("depth"))
    return tree.groupBy("equipment_type").agg(
        F.count("*").cast("int").alias("trees"),
        F.every((F.col("leaves") == F.col("psi")) & (F.col("psi") <= 256)).alias("leaves_hold_the_sample"),
        F.every(F.col("depth") <= 8).alias("depth_bounded"))


def _detect(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return ISO.detect_with(raw, _forest(spark, sf_dir, raw))


@register("detect_isolation")
def detect_isolation(spark, sf_dir):
    """ML5: isolation score and 5 %-contamination flag per reading."""
    return _detect(spark, sf_dir).select("event_id", "equipment_id", "equipment_type", "ts", "iso_score",
                                         "iso_cut", "iso_anomaly")


@register("detected_rows", with_t("""
SELECT equipment_type, count(*) AS n, true AS five_percent
FROM amx GROUP BY equipment_type""", AMX_CTE))
def detected_rows(spark, sf_dir):
    """ML5: every reading is scored once; about 5 % of the training rows are flagged."""
    rate = F.avg(F.when(F.col("unannotated"), F.col("iso_anomaly").cast("double")))
    return _detect(spark, sf_dir).groupBy("equipment_type").agg(
        F.count("*").alias("n"), (F.abs(rate - 0.05) < 0.02).alias("five_percent"))


@register("detect_combined")
def detect_combined(spark, sf_dir):
    """ML7: isolation forest OR statistical detector, with the firing detectors."""
    return ISO.combined(_detect(spark, sf_dir)).select(
        "event_id", "equipment_id", "ts", "iso_score", "iso_anomaly", "stat_anomaly", "anomaly_detected", "detectors")
