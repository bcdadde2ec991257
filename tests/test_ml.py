"""Fitted models: not bit-comparable, so check behaviour."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tankwise.operators import forecast as FC
from tankwise.operators import isolation as ISO
from tankwise.operators.models import ModelRegistry
from tankwise.operators.sequence import ordered_split
from tankwise.plans import q_ml
from tankwise.session import scratch_path
from tankwise.sources.tables import table
from support import SF_SMALL

COLS = ["a", "b", "c"]


def _iso_data(spark, n=1500, outliers=8):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, size=(n, 3))
    x[:outliers] = rng.normal(0, 1, size=(outliers, 3)) + 9.0
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=i), f"E{i % 20}", "Truck", *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, equipment_id string, "
                                       "equipment_type string, a double, b double, c double")


def test_isolation_forest_ranks_planted_outliers(spark):
    df = _iso_data(spark)
    nodes = ISO.train(df, trees=50, psi=128, seed=1, cols=COLS)
    out = ISO.detect(df, nodes, contamination=0.05, cols=COLS)
    top = [r["event_id"] for r in out.orderBy(F.col("iso_score").desc()).limit(8).collect()]
    assert set(top) == set(range(8))
    rate = out.agg(F.avg(F.col("iso_anomaly").cast("double"))).first()[0]
    assert 0.03 <= rate <= 0.07


def test_isolation_forest_deterministic(spark):
    df = _iso_data(spark, n=600)
    a = ISO.train(df, trees=10, psi=64, seed=3, cols=COLS).orderBy("tree", "node").collect()
    b = ISO.train(df, trees=10, psi=64, seed=3, cols=COLS).orderBy("tree", "node").collect()
    assert a == b and len(a) > 10


def test_isolation_samples_bounded_per_tree(spark):
    df = _iso_data(spark, n=600)
    nodes = ISO.train(df, trees=20, psi=64, seed=3, cols=COLS)
    roots = nodes.filter("node = 0").select("size").collect()
    assert all(r[0] <= 64 for r in roots) and len(roots) == 20


def _reg_data(spark, n=600):
    rng = np.random.default_rng(1)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        load = float(rng.uniform(0, 100))
        rows.append((i, t0 + dt.timedelta(hours=i), f"E{i % 5}", "Truck", "Running", "Normal",
                     load, 1000.0 + 10 * load, float(rng.uniform(0, 60)), 20.0, 80.0,
                     0.3 * load + float(rng.normal(0, 1))))
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, equipment_id string, equipment_type string, "
                                       "operational_status string, maintenance_status string, load_pct double, "
                                       "rpm double, speed double, ambient_temp double, engine_temp double, "
                                       "fuel_consumed double").withColumns(
        {"hour": F.hour("ts"), "weekday": F.weekday("ts"), "is_weekend": F.lit(0)})


def test_regressor_beats_mean_and_roundtrips(spark, tmp_dir):
    mx = FC.model_matrix(_reg_data(spark))
    assert "fuel_consumed" not in mx.columns and "label" in mx.columns     # defect Q1: no target leak
    models = FC.train_per_type(mx, kind="rf", trees=10)
    s = FC.score_per_type(mx, models)
    mean = mx.agg(F.avg("label")).first()[0]
    r = s.agg(F.sqrt(F.avg((F.col("prediction") - F.col("label")) ** 2)).alias("m"),
              F.sqrt(F.avg((F.lit(mean) - F.col("label")) ** 2)).alias("b")).first()
    assert r["m"] < 0.5 * r["b"]
    loaded = ModelRegistry(spark, tmp_dir + "/m").publish("rf", "x", {}, FC.MODEL_FEATURES, pipelines=models).pipelines
    a = {x["event_id"]: x["prediction"] for x in FC.score_per_type(mx, models).collect()}
    b = {x["event_id"]: x["prediction"] for x in FC.score_per_type(mx, loaded).collect()}
    assert a == b


def test_forecast_grid_recomputes_calendar(spark):
    feats = _reg_data(spark, n=50)
    g = FC.forecast_grid(feats, 24)
    assert g.count() == 5 * 24
    r = g.filter("h = 1").orderBy("equipment_id").first()
    assert r["forecast_ts"] == r["ts"] + dt.timedelta(hours=1) and r["hour"] == r["forecast_ts"].hour


def test_training_runs_the_windows_once(spark, monkeypatch):
    """The split and the forecast grid read stored features; the grid's rows are the same."""
    monkeypatch.setattr(q_ml, "TREES", 2)
    path = scratch_path(spark, "tables")
    table(spark, SF_SMALL, "events").write.parquet(f"{path}/events.parquet")
    split = []
    monkeypatch.setattr(q_ml, "ordered_split", lambda df, share: split.append(df) or ordered_split(df, share))
    mx, models = q_ml._trained(spark, path)
    assert "Window" not in split[0]._jdf.queryExecution().optimizedPlan().toString()
    got = q_ml._forecasts(spark, path)
    assert "avg(" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = FC.forecast(q_ml._grid(spark, path), models)
    cols = sorted(want.columns)
    assert got.count() == 24 * mx.select("equipment_id").distinct().count() and sorted(got.columns) == cols
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


# ------------------------------------------------------------ registry
def test_no_model_gives_an_empty_score(spark):
    mx = FC.model_matrix(_reg_data(spark, n=20))
    assert FC.train_per_type(mx) == {}
    scored = FC.score_per_type(mx, {})
    assert scored.count() == 0 and "prediction" in scored.columns
    assert FC.importances({}, spark).count() == 0


def test_versions_by_data_and_settings(spark):
    reg = ModelRegistry(spark, scratch_path(spark, "registry"))
    table_ = spark.createDataFrame([(1, "a")], "x int, k string")
    assert reg.find("m", "d1", {"trees": 3}) is None
    first = reg.publish("m", "d1", {"trees": 3}, ["x"], {"part": table_})
    second = reg.publish("m", "d2", {"trees": 3}, ["x"], {"part": table_.unionAll(table_)}, partition_by={"part": "k"})
    assert (first.version, second.version) == (0, 1)
    assert reg.find("m", "d1", {"trees": 3}).tables["part"].count() == 1
    assert reg.find("m", "d2", {"trees": 3}).tables["part"].count() == 2
    assert reg.find("m", "d2", {"trees": 3}, ["x"]).version == 1 and reg.find("m", "d2", {"trees": 3}, ["x", "y"]) is None
    assert reg.find("m", "d2", {"trees": 4}) is None and reg.find("other", "d1", {"trees": 3}) is None
    assert reg.load("m", 0).features == ["x"] and reg.load("m", 0).source == "d1"


def test_a_loaded_forest_scores_the_same(spark):
    raw = _iso_data(spark, n=800).withColumn("fit", F.col("event_id") % 4 != 0)
    forest = ISO.fit_forest(raw, "fit", COLS, trees=20, psi=64)
    reg = ModelRegistry(spark, scratch_path(spark, "registry"))
    ISO.save_forest(reg, "d", {"trees": 20}, forest)
    loaded = ISO.find_forest(reg, "d", {"trees": 20})
    assert loaded.features == COLS and ISO.find_forest(reg, "other", {"trees": 20}) is None
    new = raw.where("event_id < 100").unionAll(raw.where("event_id = 1").withColumn("equipment_type", F.lit("Unknown")))
    a, b = [sorted((r["event_id"], r["iso_score"], r["iso_anomaly"]) for r in ISO.detect_with(new, f).collect()) for f in (forest, loaded)]
    assert a == b and len(a) == 100            # the type without a model is left out


def _walked(x, nodes):
    """Score of one row by walking its trees node by node."""
    total = 0.0
    for tree in sorted({n["tree"] for n in nodes}):
        of = {n["node"]: n for n in nodes if n["tree"] == tree}
        n = of[0]
        while n["feature"] >= 0:
            n = of[n["left"] if x[n["feature"]] < n["threshold"] else n["right"]]
        total += n["depth"] + float(ISO.c_factor([n["size"]])[0])
    psi = np.mean([n["psi"] for n in nodes if n["node"] == 0])
    trees = max(n["tree"] for n in nodes) + 1
    return 2.0 ** (-(total / trees) / float(ISO.c_factor([psi])[0]))


def test_scores_are_those_of_a_walk_down_each_tree(spark, monkeypatch):
    monkeypatch.setattr(ISO, "PACKED_NODES", 1)          # a pack for each type
    df = _iso_data(spark, n=300).withColumn("equipment_type", F.when(F.col("event_id") % 3 == 0, "Truck").when(
        F.col("event_id") % 3 == 1, "Crane").when(F.col("event_id") % 2 == 0, "Unknown"))
    nodes = ISO.train(df.where("equipment_type in ('Truck', 'Crane')"), trees=15, psi=32, seed=2, cols=COLS)
    trees = {t: [n for n in nodes.collect() if n["equipment_type"] == t] for t in ("Truck", "Crane")}
    values = {r["event_id"]: [r[c] for c in COLS] for r in df.collect()}
    rows = ISO.score(df, nodes, COLS).collect()
    assert sorted(r["event_id"] for r in rows) == list(range(300))
    for r in rows:
        want = _walked(values[r["event_id"]], trees[r["equipment_type"]]) if r["equipment_type"] in trees else None
        assert r["iso_score"] is want or abs(r["iso_score"] - want) < 1e-12


def test_both_forests_score_each_reading_once(spark, monkeypatch):
    """Resent readings and readings without an id are rows of their own."""
    monkeypatch.setattr(q_ml, "FOREST", {"trees": 3, "psi": 32, "seed": 1, "contamination": 0.05})
    path = scratch_path(spark, "tables")
    ev = table(spark, SF_SMALL, "events")
    rows = ev.unionAll(ev.where("event_id < 200"))
    rows.repartition(1).write.parquet(f"{path}/events.parquet")
    out = q_ml.forest_roundtrip(spark, path).collect()
    assert sum(r["n"] for r in out) == rows.count()
    assert all(r["max_abs_diff"] == 0 and r["flags_changed"] == 0 for r in out)


def test_a_changed_table_trains_anew(spark, monkeypatch):
    monkeypatch.setattr(q_ml, "TREES", 3)
    path = scratch_path(spark, "tables")
    ev = table(spark, SF_SMALL, "events")
    ev.where("event_id <= 700").repartition(1).write.parquet(f"{path}/events.parquet")
    log = q_ml.registry(spark, path).log("consumption-rf")
    first, _ = q_ml._trained(spark, path)
    assert log.numbers() == [0]
    again, models = q_ml._trained(spark, path)
    assert log.numbers() == [0] and again.count() == first.count() == 701
    ev.where("event_id > 700").repartition(1).write.mode("append").parquet(f"{path}/events.parquet")
    more, _ = q_ml._trained(spark, path)
    assert log.numbers() == [0, 1] and more.count() == ev.count()
    monkeypatch.setattr(q_ml, "TREES", 4)
    q_ml._trained(spark, path)
    assert log.numbers() == [0, 1, 2]


def test_model_forecasts_reach_the_insights(spark, monkeypatch):
    """The refuelling insight of a unit quotes the runtime by the models' mean forecast."""
    from tankwise.plans import q_insights as Q
    monkeypatch.setattr(q_ml, "TREES", 3)
    mean = {r["equipment_id"]: r["m"] for r in q_ml._forecasts(spark, SF_SMALL).groupBy("equipment_id")
            .agg(F.avg("predicted_consumption").alias("m")).collect()}
    run = {r["equipment_id"]: r for r in Q.runtime_from_models(spark, SF_SMALL).collect()}
    assert set(run) == set(mean)
    for u, r in run.items():
        assert abs(r["predicted_consumption"] - mean[u]) < 1e-9
        assert r["estimated_runtime"] is None if mean[u] <= 0 else abs(r["estimated_runtime"] - r["fuel_level"] / mean[u]) < 1e-9
    quoted = {r["equipment_id"]: r for r in Q.insights_from_models(spark, SF_SMALL).where("insight_type = 'refueling'").collect()}
    assert quoted
    for u, r in quoted.items():
        assert abs(r["metric_value"] - run[u]["estimated_runtime"]) < 1e-9
        assert r["details"]["estimated_runtime"] == f"{run[u]['estimated_runtime']:.4f}"
