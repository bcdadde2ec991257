"""Readers for the provided parquet tables and the telemetry view over them.

The telemetry view maps ``events`` (one row per user and time) onto the
canonical telemetry columns: each ``user_id`` is one piece of equipment.
The mapping text is plain SQL valid in Spark and DuckDB so the same rows
feed both the Spark jobs and the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fixed mapping of events onto telemetry (fixture definition; literals are in
# exponent form so both engines compute in DOUBLE).
TELEMETRY_SQL = """
SELECT event_id, ts, equipment_id, driver_id, equipment_type,
  fuel_level, fuel_consumed, tank_capacity, idle_time, load_pct, rpm, speed,
  speed * (1e0 - idle_time / 6e1) AS distance,
  fuel_price, ambient_temp, ambient_temp + 4e1 + load_pct * 3e-1 AS engine_temp,
  oil_pressure, load_pct * 9e-1 AS throttle, battery_voltage, gear, driving_mode, sensor_fault,
  CASE WHEN operational_status = 'Stopped' THEN 0e0 ELSE 2e2 * (7e-1 + 3e-1 * load_pct / 1e2) END AS emission_rate,
  CASE WHEN fuel_consumed > 0e0 AND speed > 0e0 THEN speed * (1e0 - idle_time / 6e1) / fuel_consumed ELSE 0e0 END AS fuel_efficiency,
  CASE WHEN hours_since_service > 5e2 THEN 'Needs Service' WHEN hours_since_service > 4e2 THEN 'Service Due Soon' ELSE 'Normal' END AS maintenance_status,
  hours_since_service, operational_status, refuel_event,
  CASE WHEN refuel_event = 'Yes' THEN 'Refueling event'
       WHEN sensor_fault > 0 THEN concat('Sensor fault detected: ', CAST(sensor_fault AS STRING))
       WHEN hours_since_service > 5e2 THEN 'Maintenance needed'
       WHEN fuel_level < tank_capacity * 1e-1 THEN 'Low fuel warning' END AS event_notes,
  location
FROM (
  SELECT event_id, ts,
    concat('EQ-', lpad(CAST(user_id AS STRING), 4, '0')) AS equipment_id,
    concat('D-', lpad(CAST(user_id % 50 AS STRING), 3, '0')) AS driver_id,
    CASE user_id % 4 WHEN 0 THEN 'Generator' WHEN 1 THEN 'Truck' WHEN 2 THEN 'Excavator' ELSE 'Forklift' END AS equipment_type,
    CAST(150 + 50 * (user_id % 3) AS DOUBLE) AS tank_capacity,
    CAST(150 + 50 * (user_id % 3) AS DOUBLE) * k / 1e2 AS fuel_level,
    CASE WHEN event_type = 'error' THEN 0e0 ELSE value END AS fuel_consumed,
    CASE WHEN event_type = 'view' THEN k * 6e-1 ELSE 0e0 END AS idle_time,
    CASE WHEN event_type = 'error' THEN 0e0 ELSE CAST((event_id * 7) % 111 AS DOUBLE) END AS load_pct,
    CASE WHEN event_type = 'error' THEN 0e0 ELSE CAST(600 + (event_id * 13) % 2600 AS DOUBLE) END AS rpm,
    CASE WHEN event_type IN ('error', 'view') THEN 0e0 ELSE CAST((event_id * 11) % 61 AS DOUBLE) END AS speed,
    CAST(90 + (event_id * 29) % 20 AS DOUBLE) AS fuel_price,
    CAST((event_id * 3) % 46 - 10 AS DOUBLE) AS ambient_temp,
    CAST((event_id * 17) % 67 + 10 AS DOUBLE) AS oil_pressure,
    11e0 + CAST((event_id * 19) % 71 AS DOUBLE) * 1e-1 AS battery_voltage,
    CASE WHEN event_type IN ('error', 'view') THEN 'N' ELSE CAST(event_id % 5 + 1 AS STRING) END AS gear,
    CASE WHEN event_type = 'error' THEN 'N/A' WHEN event_id % 3 = 0 THEN 'Eco' WHEN event_id % 3 = 1 THEN 'Normal' ELSE 'Power' END AS driving_mode,
    CAST(CASE WHEN event_id % 101 = 0 THEN 101 + user_id % 3 ELSE 0 END AS INT) AS sensor_fault,
    CAST((event_id * 23) % 560 AS DOUBLE) AS hours_since_service,
    CASE WHEN event_type = 'error' THEN 'Stopped' ELSE 'Running' END AS operational_status,
    CASE WHEN event_type = 'purchase' THEN 'Yes' ELSE 'No' END AS refuel_event,
    concat('Site_', CAST(user_id % 5 + 1 AS STRING)) AS location
  FROM (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM {events}) b
) c
"""


def telemetry_from_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Telemetry rows over an ``events``-shaped DataFrame (batch or stream)."""
    return spark.sql(TELEMETRY_SQL, events=events)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_from_events(spark, table(spark, sf_dir, "events"))


# Vehicle-economy-shaped rows over ``part`` (fixture mapping: class from
# p_type, combined figure from p_size).  Valid in Spark and DuckDB.
ECONOMY_SQL = """
SELECT CAST(2000 + p_partkey % 20 AS INT) AS year, p_brand AS make, p_name AS model,
  CASE p_type WHEN 'SMALL' THEN 'Small Cars' WHEN 'MEDIUM' THEN 'Midsize Cars' WHEN 'LARGE' THEN 'Large Cars'
    WHEN 'ECONOMY' THEN 'Small Pickup Trucks 2WD' WHEN 'PROMO' THEN 'Vans, Cargo Type'
    ELSE 'Special Purpose Vehicle 4WD' END AS VClass,
  CAST(p_size AS DOUBLE) / 1e1 AS displ, CAST(4 + 2 * (p_partkey % 3) AS INT) AS cylinders,
  'Automatic' AS trany,
  CAST(p_size AS DOUBLE) * 9e-1 AS city08, CAST(p_size AS DOUBLE) * 1.2e0 AS highway08,
  CAST(p_size AS DOUBLE) AS comb08,
  CASE p_partkey % 5 WHEN 0 THEN 'Regular Gasoline' WHEN 1 THEN 'Premium Gasoline' WHEN 2 THEN 'Diesel'
    WHEN 3 THEN 'CNG' ELSE 'Electricity' END AS fuelType,
  p_partkey
FROM {part}
"""

# Fuel-ratings-shaped rows over ``orders`` (fixture mapping: fuel label from
# o_orderpriority and o_orderstatus, CO2 from o_totalprice).
FUEL_RATINGS_SQL = """
SELECT o_orderkey,
  concat(CASE o_orderpriority WHEN '1-URGENT' THEN 'Diesel' WHEN '2-HIGH' THEN 'Regular Gasoline'
      WHEN '3-MEDIUM' THEN 'Natural Gas' WHEN '4-NOT SPECIFIED' THEN 'X' ELSE 'Electric' END,
    CASE WHEN o_orderstatus = 'O' THEN '' ELSE concat(' ', o_orderstatus) END) AS fuel_type,
  o_totalprice / 1e3 AS co2_emissions
FROM {orders}
"""


def economy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ECONOMY_SQL, part=table(spark, sf_dir, "part"))


def fuel_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FUEL_RATINGS_SQL, orders=table(spark, sf_dir, "orders"))
