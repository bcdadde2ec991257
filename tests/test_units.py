"""Small hand-built cases: sources, scalar functions, patterns, defects Q1-Q17."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from tankwise.functions import scalar as S
from tankwise.operators import anomaly as A
from tankwise.operators import insights as I
from tankwise.operators import patterns as P
from tankwise.sources import files as SF


# The header line as the file has it.
HEADER = ("Timestamp,Equipment_ID,Driver_ID,Equipment_Type,Fuel_Level (L),Fuel_Consumed (L/hr),Fuel_Tank_Capacity (L),"
          "Idle_Time (min),Load (%),RPM,Speed (km/h),Distance_Travelled (km),Fuel_Price (₹),Temperature (°C),"
          "Engine_Temperature (°C),Oil_Pressure (psi),Throttle_Position (%),Gear_Position,Driving_Mode,"
          "Battery_Voltage (V),Sensor_Fault_Code,Fuel_Efficiency (km/L),Emission_Rate (g/km),Maintenance_Status,"
          "Time_Since_Last_Service (hrs),Average_Load_Last_3hr (%),Operational_Status,Refuel_Event,Event_Notes,Location")
VALUES = ["2024-01-01 00:00:00", "EQ1", "D1", "Truck", "-5", "400", "200", "0", "300", "", "10", "9", "95", "999", "120",
          "30", "50", "3", "Eco", "12.1", "0", "2.5", "200", "Due", "410", "61.5", "Idle", "No", "", "Site_1"]


def test_telemetry_csv_with_bom_and_blanks(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\ufeff" + HEADER + "\n" + ",".join(VALUES) + "\n")
    df = SF.read_telemetry_csv(spark, path)
    r = df.collect()[0]
    assert df.columns[0] == "ts" and r["ts"] == dt.datetime(2024, 1, 1)
    assert r["rpm"] is None and r["event_notes"] is None      # blanks are NULL
    assert r["fuel_level"] == -5.0 and r["ambient_temp"] == 999.0  # dirty values kept
    assert r["avg_load_3h"] == 61.5 and r["battery_voltage"] == 12.1 and r["emission_rate"] == 200.0
    assert SF.read_telemetry_raw(spark, path).collect()[0]["gear"] == "3"


def test_telemetry_columns_are_found_by_name(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t.csv")
    pairs = [p for p in zip(HEADER.split(","), VALUES) if p[0] != "Driving_Mode"][::-1]
    with open(path, "w", encoding="utf-8") as f:
        f.write(",".join(k for k, _ in pairs) + "\n" + ",".join(v for _, v in pairs) + "\n")
    r = SF.read_telemetry_csv(spark, path).collect()[0]
    assert r["avg_load_3h"] == 61.5 and r["driving_mode"] is None and r["equipment_id"] == "EQ1"


def test_ingest_clean_nonfinite_and_junk(spark):
    raw = spark.createDataFrame([("1", "NaN", "abc", "Infinity", "2024-01-01 01:02:03.5")],
                                "event_id string, rpm string, load_pct string, speed string, ts string")
    r = SF.ingest_clean(raw).collect()[0]
    assert r["rpm"] is None and r["load_pct"] is None and r["speed"] is None
    assert r["ts"] == dt.datetime(2024, 1, 1, 1, 2, 3, 500000) and r["event_id"] == 1


def test_auto_mpg_parse_and_drop(spark, tmp_dir):
    path = os.path.join(tmp_dir, "auto.data")
    with open(path, "w") as f:
        f.write('18.0   8   307.0      130.0      3504.      12.0   70  1\t"chevrolet chevelle malibu"\n')
        f.write('25.0   4   98.00      ?          2046.      19.0   71  1\t"ford pinto"\n')
    df = SF.read_auto_mpg(spark, path)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["car_name"] == "chevrolet chevelle malibu"
    assert abs(rows[0]["weight_kg"] - 3504 * 0.453592) < 1e-9
    assert abs(rows[0]["fuel_efficiency_km_per_l"] - 18 * 0.425) < 1e-12


def test_auto_mpg_matches_a_line_once(spark, tmp_dir):
    path = os.path.join(tmp_dir, "auto.data")
    with open(path, "w") as f:
        f.write('18.0 8 307.0 130.0 3504. 12.0 70 1\t"a "quoted" name"  \n')
        f.write('18.0 8 307.0 130.0 3504. 12.0 70 1\t""\n')             # no name
        f.write('18.0 8 307.0 130.0 3504. 12.0 70\t"a field short"\n')
        f.write('\nno line of the file\n')
    df = SF.read_auto_mpg(spark, path)
    assert [r["car_name"] for r in df.collect()] == ['a "quoted" name']
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_") == 1


def test_candidate_paths_first_readable_wins(spark, tmp_dir):
    good = os.path.join(tmp_dir, "r.csv")
    with open(good, "w") as f:
        f.write("Fuel Type,CO2 Emissions(g/km)\nX,200\nD,180\n")
    df = SF.read_first_available(spark, [os.path.join(tmp_dir, "missing.csv"), good], SF.read_fuel_ratings)
    out = SF.resolve_ratings(df).orderBy("fuel_type").collect()
    assert [(r["fuel_type"], r["co2_emissions"]) for r in out] == [("D", 180.0), ("X", 200.0)]


def test_config_defaults_and_override(spark, tmp_dir):
    d = SF.read_config(spark, None)
    thr = {r["equipment_type"]: r["good"] for r in SF.efficiency_thresholds(d).collect()}
    assert thr["Truck"] == 0.85 and thr["default"] == 0.8
    cfg = json.loads(SF.config_json_text())
    cfg["efficiency_thresholds"]["Truck"]["good"] = 0.9
    p = os.path.join(tmp_dir, "cfg.json")
    with open(p, "w") as f:
        json.dump(cfg, f, indent=2)
    thr = {r["equipment_type"]: r["good"] for r in SF.efficiency_thresholds(SF.read_config(spark, p)).collect()}
    assert thr["Truck"] == 0.9
    scal = {(r["section"], r["name"]): r["value"] for r in SF.scalar_thresholds(d).collect()}
    assert scal[("maintenance_thresholds", "service_due_hours")] == 500.0


def test_lookup_json_integer_keys(spark, tmp_dir):
    df = spark.createDataFrame([("hourly", 0, 0.5), ("hourly", 13, 0.9)], "period string, key int, value double")
    p = os.path.join(tmp_dir, "lk")
    SF.write_lookup_json(df, "period", "key", "value", p)
    text = open([os.path.join(p, f) for f in os.listdir(p) if f.endswith(".json")][0]).read()
    assert '"0":0.5' in text and '"0.0"' not in text   # defect Q3: no float keys
    back = {(r["period"], r["key"]): r["value"] for r in SF.read_lookup_json(spark, p, "period").collect()}
    assert back == {("hourly", 0): 0.5, ("hourly", 13): 0.9}


def test_fuel_type_natural_gas_first(spark):
    df = spark.createDataFrame([("Natural Gas",), ("Gasoline",), ("x",), ("D",), ("battery",), ("CNG",), (None,)],
                               "f string")
    out = [r[0] for r in df.select(S.fuel_type_group(F.col("f"))).collect()]
    assert out == ["Natural Gas", "Gasoline", "Gasoline", "Diesel", "Electric", "Natural Gas", "Other"]


def test_class_and_name_keywords(spark):
    df = spark.createDataFrame([("Small Pickup Trucks 2WD",), ("Vans, Cargo Type",), ("Minicompact",),
                                ("Special Purpose Vehicle",)], "c string")
    out = [r[0] for r in df.select(S.class_to_equipment(F.col("c"))).collect()]
    assert out == ["Loader", "Truck", "Truck", "Bulldozer"]
    names = spark.createDataFrame([("CAT wheel loader",), ("mini excavator",), ("pump",)], "n string")
    assert [r[0] for r in names.select(S.normalize_equipment_name(F.col("n"))).collect()] == \
        ["Loader", "Excavator", "Other"]


def test_severity_uses_rank_not_text(spark):
    df = spark.createDataFrame([("Fuel Theft", 0.9), ("Fuel Theft", 0.1), ("Idle", 0.5), ("Oil Pressure", 0.45)],
                               "t string, s double")
    out = [r[0] for r in df.select(S.severity(F.col("t"), F.col("s"))).collect()]
    assert out == ["critical", "high", "medium", "high"]   # defect Q9: critical stays critical


def test_trend_negative_first_value(spark):
    df = spark.createDataFrame([(-10.0, -10.2, 5), (10.0, 12.0, 5), (10.0, 10.0, 1)], "a double, b double, n long")
    out = [r[0] for r in df.select(S.trend_direction("a", "b", "n")).collect()]
    assert out == ["stable", "increasing", "stable"]     # defect Q17


def test_unit_detection_even_count_straddle(spark):
    df = spark.createDataFrame([(10.0,), (14.0,), (17.0,), (30.0,)], "x double")
    r = P.unit_detection(df, "x").collect()[0]
    assert r["median_value"] == 15.5 and r["is_mpg"] is True
    df2 = spark.createDataFrame([(10.0,), (14.0,), (15.5,), (30.0,)], "x double")
    assert P.unit_detection(df2, "x").collect()[0]["is_mpg"] is False


def test_bin_average_edges_and_fallback(spark):
    df = spark.createDataFrame([(10.0, 1.0), (19.999, 3.0), (20.0, 10.0), (5.0, 100.0)], "x double, y double")
    out = {r["lo"]: (r["n"], r["value"]) for r in P.bin_average(df, "x", "y", [10, 20, 30, 40]).collect()}
    assert out[10.0] == (2, 2.0) and out[20.0] == (1, 10.0)
    line = P.regression_line(df, "x", "y").collect()[0]
    assert abs(out[30.0][1] - (line["intercept"] + line["slope"] * 35)) < 1e-9


def test_equipment_patterns_defaults_for_missing_column(spark):
    df = spark.createDataFrame([("Truck", 5.0, None), ("Truck", 7.0, None)],
                               "equipment_type string, fuel_consumed double, rpm double")
    out = {r["metric"]: r for r in P.equipment_patterns(df).collect()}
    assert out["fuel_consumed"]["mean"] == 6.0 and out["fuel_consumed"]["min"] == 5.0
    assert out["rpm"]["mean"] == 1500.0 and out["rpm"]["std"] == 150.0     # all null -> default
    assert out["speed"]["max"] == 30.0                                       # absent -> default
    one = spark.createDataFrame([("X", 5.0)], "equipment_type string, fuel_consumed double")
    assert {r["metric"]: r["std"] for r in P.equipment_patterns(one).collect()}["fuel_consumed"] == 0.1


def test_unannotated_null_or_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Refueling event")], "event_id long, event_notes string")
    assert sorted(r[0] for r in A.unannotated(df).collect()) == [1, 2]    # defect Q2


def test_insight_priority_order_high_first(spark):
    t = dt.datetime(2024, 1, 1)
    cols = I.INSIGHT_COLUMNS
    a = spark.createDataFrame([("x", None, "low", "E1", t, "m", 1.0, "a")], ", ".join(
        f"{c} {ty}" for c, ty in zip(cols, ["string", "string", "string", "string", "timestamp_ntz",
                                            "string", "double", "string"])))
    b = a.withColumn("priority", F.lit("high")).withColumn("equipment_id", F.lit("E2"))
    out = [r["priority"] for r in I.order_insights(I.insights_all(a, b)).collect()]
    assert out == ["high", "low"]                                             # defect Q8


def test_rule_theft_skips_refuel(spark):
    t = dt.datetime(2024, 1, 1)
    base = dict(fuel_consumed=1.0, idle_time=0.0, speed=10.0, engine_temp=80.0, oil_pressure=40.0,
                battery_voltage=12.0, sensor_fault=0, rpm=1000.0, load_pct=50.0, operational_status="Running",
                expected_consumption=10.0)
    rows = [dict(base, prev_level=100.0, fuel_level=50.0, refuel_event="No"),
            dict(base, prev_level=100.0, fuel_level=50.0, refuel_event="Yes"),
            dict(base, prev_level=100.0, fuel_level=98.0, refuel_event="No")]
    df = spark.createDataFrame(rows)
    theft = A.rule_flags()["Fuel Theft"]
    assert [r[0] for r in df.select(theft).collect()] == [True, False, False]


def test_schema_drift_and_alignment(spark):
    from tankwise.operators.forecast import align_to_training, schema_drift
    train = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    pred = spark.createDataFrame([(1.0, 5.0)], "a double, d double")
    assert schema_drift(train, pred) == {"missing": ["b", "c"], "extra": ["d"]}
    out = align_to_training(pred, train.columns)
    assert out.columns == ["a", "b", "c"] and tuple(out.first()) == (1.0, 0.0, 0.0)


def test_state_histories_bounded_and_ordered(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=i), "U1", float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, equipment_id string, fuel_consumed double")
    h = I.recent_history(df, "fuel_consumed", "hist", 24).collect()[0]["hist"]
    assert len(h) == 24
    assert [x["ts"] for x in h] == sorted(x["ts"] for x in h)
    assert h[-1]["ts"] == t0 + dt.timedelta(hours=59) and all(x["value"] > 0 for x in h)


def test_persist_insights_partition_pruning(spark, tmp_dir):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("idle", "high", "E1", t), ("idle", "low", "E2", t)],
                               "insight_type string, priority string, equipment_id string, as_of timestamp_ntz")
    I.persist_insights(df, tmp_dir + "/ins")
    back = spark.read.parquet(tmp_dir + "/ins").filter(F.col("priority") == "high")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(priority" in plan and back.count() == 1


def test_served_figures_and_times(spark):
    import datetime as dt

    from tankwise.functions import scalar as S
    xs = [0.25, 0.35, 2.5, -0.25, 1.005, 12.349, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(S.half_even("x", 1)).collect()]
    assert got[:4] == [0.2, 0.4, 2.5, -0.2] and got[5] == 12.3 and got[6] is None
    assert [r[0] for r in df.orderBy("i").limit(1).select(S.clamp(F.lit(120.0), 0.0, 100.0)).collect()] == [100.0]
    t = dt.datetime(2024, 1, 1, 23, 0, 5)
    rows = spark.createDataFrame([(t,), (t.replace(microsecond=70),)], "ts timestamp_ntz")
    assert [r[0] for r in rows.orderBy("ts").select(S.iso_text(S.plus_hours("ts", 2))).collect()] == [
        x.isoformat() for x in (t + dt.timedelta(hours=2), t.replace(microsecond=70) + dt.timedelta(hours=2))]
    assert spark.range(1).select(S.metric_short_name(F.lit("Speed (km/h)"))).first()[0] == "speed"
