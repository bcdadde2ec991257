"""Typed insight records: details, actions, messages and thresholds from a file."""

import copy
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tankwise.operators import insights as I
from tankwise.plans.registry import prepare
from tankwise.session import scratch_path
from tankwise.sources.files import DEFAULT_CONFIG

AT = dt.datetime(2024, 2, 1)


@pytest.fixture(scope="module")
def state(spark):
    prepare(spark)
    rows = [("good", "Truck", 6.0, 480.0, 90.0, 100.0, 50.0, 2, 8), ("middle", "Forklift", 6.0, 520.0, 15.0, 100.0, 3.0, 9, 1),
            ("poor", "Crane", 1.0, 10.0, 24.0, 100.0, 5.0, 0, 9), ("none", "Truck", None, None, 9.0, 100.0, None, 0, 0)]
    return spark.createDataFrame(
        [(u, t, e, 9 if e else 0, h, fl, cap, fl / cap * 100, rt, idle, act, AT) for u, t, e, h, fl, cap, rt, idle, act in rows],
        "equipment_id string, equipment_type string, avg_efficiency double, n_efficiency long, hours_since_service double, fuel_level double, "
        "tank_capacity double, fuel_level_percentage double, estimated_runtime double, total_idle_time long, total_active_time long, as_of timestamp_ntz")


def by_unit(df):
    return {r["equipment_id"]: r for r in df.collect()}


def test_details_are_data_and_actions_are_lists(state):
    got = by_unit(I.insights_efficiency(state))
    assert got["good"]["details"] == {"avg_efficiency": "6.0000", "baseline": "6.0000", "ratio": "1.0000"}
    assert got["poor"]["action_list"] == I.ACTIONS["efficiency", "high"] and got["poor"]["priority"] == "high"
    got = by_unit(I.insights_maintenance(state))
    assert got["good"]["details"] == {"hours_since_service": "480.0000", "threshold": "500.0000", "hours_remaining": "20.0000"}
    assert set(got["middle"]["details"]) == {"hours_since_service", "threshold"}
    got = by_unit(I.insights_refuel(state))
    assert set(got) == {"middle", "poor"}
    assert got["middle"]["details"] == {"fuel_percentage": "15.0000", "estimated_runtime": "3.0000", "fuel_level": "15.0000", "fuel_capacity": "100.0000"}
    assert by_unit(I.insights_idle(state))["middle"]["details"] == {"idle_time": "9", "active_time": "1", "idle_ratio": "0.9000"}


def test_formatter_variants(spark, state):
    texts = {}
    for part in (I.insights_efficiency(state), I.insights_maintenance(state), I.insights_refuel(state), I.insights_idle(state)):
        for r in part.select("insight_type", "equipment_id", I.formatted(part).alias("m")).collect():
            texts[r["insight_type"], r["equipment_id"]] = r["m"]
    assert texts["maintenance", "good"] == "Maintenance due soon. Hours remaining: 20.0"
    assert texts["maintenance", "middle"] == "Maintenance overdue. Hours since last service: 520.0"
    assert texts["refueling", "middle"] == "Low fuel alert. Estimated runtime: 3.0 hours."
    assert texts["refueling", "poor"] == "Plan refueling soon. Estimated runtime: 5.0 hours."
    assert texts["idle", "middle"] == "Insight generated."
    empty = state.withColumn("fuel_level_percentage", F.lit(4.0))
    low = I.insights_refuel(empty)
    assert {r[0] for r in low.select(I.formatted(low)).collect() if "3.0" in r[0]} == {"Critical fuel level. Estimated runtime: 3.0 hours."}


def test_a_changed_threshold_file_changes_the_insights(spark, state):
    config = copy.deepcopy(DEFAULT_CONFIG)
    config["maintenance_thresholds"] = {"service_due_hours": 470, "service_warning_hours": 5}
    config["efficiency_thresholds"]["Truck"] = {"good": 1.5, "average": 1.2, "poor": 1.0}
    config["idle_thresholds"]["daily_idle_ratio"] = 0.95
    config["refuel_thresholds"] = {"low_fuel_percentage": 10, "optimal_refuel_percentage": 20}
    path = scratch_path(spark, "config")
    spark.createDataFrame([(json.dumps(config, indent=1),)], "value string").coalesce(1).write.text(path)
    limits = I.Limits.read(spark, path)
    service = by_unit(I.insights_maintenance(state, limits))
    assert {u: r["priority"] for u, r in service.items()} == {"good": "high", "middle": "high", "poor": "medium"}
    assert by_unit(I.insights_efficiency(state, limits))["good"]["priority"] == "high"
    assert I.insights_idle(state, limits).count() == 0
    assert {u: r["priority"] for u, r in by_unit(I.insights_refuel(state, limits)).items()} == {"middle": "medium"}
    assert I.Limits.read(spark, None) == I.DEFAULT_LIMITS == I.Limits.read(spark, path + "-missing")
