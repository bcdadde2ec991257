"""File sources and sinks in the reference's shapes (SRC1-SRC6, SNK1-SNK4).

Readers use explicit schemas (no inference job) and rename source headers
(units, spaces, degree/rupee signs) to canonical names once at ingestion.
Writers write Parquet by default; CSV/JSON/text only where the shape is the
point.  Paths are shared-filesystem paths (``session.scratch_path``).
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The telemetry CSV's header names, in the file's order, and their
# canonical names and types.
TELEMETRY_SOURCE_COLUMNS = [
    ("Timestamp", "ts", T.TimestampNTZType()),
    ("Equipment_ID", "equipment_id", T.StringType()),
    ("Driver_ID", "driver_id", T.StringType()),
    ("Equipment_Type", "equipment_type", T.StringType()),
    ("Fuel_Level (L)", "fuel_level", T.DoubleType()),
    ("Fuel_Consumed (L/hr)", "fuel_consumed", T.DoubleType()),
    ("Fuel_Tank_Capacity (L)", "tank_capacity", T.DoubleType()),
    ("Idle_Time (min)", "idle_time", T.DoubleType()),
    ("Load (%)", "load_pct", T.DoubleType()),
    ("RPM", "rpm", T.DoubleType()),
    ("Speed (km/h)", "speed", T.DoubleType()),
    ("Distance_Travelled (km)", "distance", T.DoubleType()),
    ("Fuel_Price (₹)", "fuel_price", T.DoubleType()),
    ("Temperature (°C)", "ambient_temp", T.DoubleType()),
    ("Engine_Temperature (°C)", "engine_temp", T.DoubleType()),
    ("Oil_Pressure (psi)", "oil_pressure", T.DoubleType()),
    ("Throttle_Position (%)", "throttle", T.DoubleType()),
    ("Gear_Position", "gear", T.StringType()),
    ("Driving_Mode", "driving_mode", T.StringType()),
    ("Battery_Voltage (V)", "battery_voltage", T.DoubleType()),
    ("Sensor_Fault_Code", "sensor_fault", T.IntegerType()),
    ("Fuel_Efficiency (km/L)", "fuel_efficiency", T.DoubleType()),
    ("Emission_Rate (g/km)", "emission_rate", T.DoubleType()),
    ("Maintenance_Status", "maintenance_status", T.StringType()),
    ("Time_Since_Last_Service (hrs)", "hours_since_service", T.DoubleType()),
    ("Average_Load_Last_3hr (%)", "avg_load_3h", T.DoubleType()),
    ("Operational_Status", "operational_status", T.StringType()),
    ("Refuel_Event", "refuel_event", T.StringType()),
    ("Event_Notes", "event_notes", T.StringType()),
    ("Location", "location", T.StringType()),
]
TS_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
EXTRA_KEY = "event_id"  # carried through round trips of the test view


def to_source_names(df: DataFrame) -> DataFrame:
    m = {canon: src for src, canon, _ in TELEMETRY_SOURCE_COLUMNS}
    return df.select(*[F.col(c).alias(m.get(c, c)) for c in df.columns])


def to_canonical_names(df: DataFrame) -> DataFrame:
    m = {src: canon for src, canon, _ in TELEMETRY_SOURCE_COLUMNS}
    return df.select(*[F.col(f"`{c}`").alias(m.get(c, c)) for c in df.columns])


def write_telemetry_csv(df: DataFrame, path: str) -> None:
    """SNK1 (CSV form): header row, source column names, blanks for NULL."""
    (to_source_names(df).write.mode("overwrite").option("header", True)
        .option("timestampNTZFormat", TS_FORMAT).csv(path))


def read_telemetry_csv(spark: SparkSession, path: str, include_key: bool = False) -> DataFrame:
    """SRC1: header, UTF-8 BOM, blanks as NULL; columns are found by their header
    names wherever they stand (a missing one is NULL), renamed and typed."""
    return ingest_clean(read_telemetry_raw(spark, path, include_key))


def read_telemetry_raw(spark: SparkSession, path: str, include_key: bool = False) -> DataFrame:
    """All-string read of the telemetry CSV (input of ``ingest_clean``).  Only the
    header line is looked at beforehand; no types are inferred."""
    df = spark.read.option("header", True).csv(path)
    names = {c.replace("\ufeff", "").strip(): c for c in df.columns}
    wanted = [(src, canon) for src, canon, _ in TELEMETRY_SOURCE_COLUMNS]
    if include_key:
        wanted.append((EXTRA_KEY, EXTRA_KEY))
    return df.select(*[(F.col(f"`{names[src]}`") if src in names else F.lit(None).cast("string")).alias(canon)
                       for src, canon in wanted])


def ingest_clean(raw: DataFrame) -> DataFrame:
    """PRJ6/PRJ14 at ingestion: try_cast every field to its canonical type
    (unparseable -> NULL), NaN/+-inf -> NULL, timestamps parsed as NTZ."""
    types = {canon: typ for _, canon, typ in TELEMETRY_SOURCE_COLUMNS}
    types[EXTRA_KEY] = T.LongType()
    out = []
    for c in raw.columns:
        typ = types.get(c, T.StringType())
        col = F.trim(F.col(c))
        if isinstance(typ, T.TimestampNTZType):
            v = F.try_to_timestamp(col, F.lit(TS_FORMAT)).cast("timestamp_ntz")
        elif isinstance(typ, T.DoubleType):
            d = col.try_cast("double")
            v = F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(None)).otherwise(d)
        elif isinstance(typ, T.StringType):
            v = F.col(c)
        else:
            v = col.try_cast(typ)
        out.append(v.alias(c))
    return raw.select(*out)


# ------------------------------------------------------------------ SRC2
AUTO_MPG_COLUMNS = ["mpg", "cylinders", "displacement", "horsepower", "weight", "acceleration",
                    "model_year", "origin", "car_name"]
AUTO_MPG_PATTERN = (r'^\s*(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+"(.*)"\s*$')


def read_auto_mpg(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: whitespace-delimited text, ``?`` = missing, quoted trailing name;
    horsepower coerced to a number; any row with a NULL dropped; kg, km/L and
    L/h derived."""
    lines = spark.read.text(path)
    # One match a line: its groups come back joined by a character that no line holds.
    fields = F.split(F.regexp_replace("value", AUTO_MPG_PATTERN + r"[\s\S]*", "\n".join(f"${i + 1}" for i in range(len(AUTO_MPG_COLUMNS)))), "\n")
    # Bound by explode, they are found once a line for all columns.  A line without a match is one field.
    df = (lines.select(F.explode(F.array(fields)).alias("f")).where(F.size("f") == len(AUTO_MPG_COLUMNS))
          .select(*[F.col("f")[i].alias(c) for i, c in enumerate(AUTO_MPG_COLUMNS)]).where(F.col("car_name") != ""))
    num = {c: F.when(F.col(c) == "?", F.lit(None)).otherwise(F.col(c)).try_cast("double")
           for c in AUTO_MPG_COLUMNS[:-1]}
    df = df.withColumns(num).withColumns({"cylinders": F.col("cylinders").cast("int"),
                                          "model_year": F.col("model_year").cast("int"),
                                          "origin": F.col("origin").cast("int")})
    df = df.na.drop("any")
    from tankwise.functions import scalar as S
    # litres an hour at a mean speed of 60 km/h
    return df.withColumns({"weight_kg": S.lb_to_kg("weight"), "fuel_efficiency_km_per_l": S.mpg_to_km_per_l("mpg"),
                           "fuel_consumption_l_per_hr": S.km_per_l_to_l_per_h(S.mpg_to_km_per_l("mpg"))})


def write_auto_mpg(df: DataFrame, path: str) -> None:
    """Text writer for the auto-MPG layout (numbers pre-formatted as strings)."""
    line = F.concat(*[F.concat(F.col(c).cast("string"), F.lit("   ")) for c in AUTO_MPG_COLUMNS[:-1]],
                    F.lit("\t\""), F.col("car_name"), F.lit("\""))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


# ------------------------------------------------------------------ SRC3-SRC5
ECONOMY_SCHEMA = T.StructType([
    T.StructField("year", T.IntegerType()), T.StructField("make", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("VClass", T.StringType()),
    T.StructField("displ", T.DoubleType()), T.StructField("cylinders", T.IntegerType()),
    T.StructField("trany", T.StringType()), T.StructField("city08", T.DoubleType()),
    T.StructField("highway08", T.DoubleType()), T.StructField("comb08", T.DoubleType()),
    T.StructField("fuelType", T.StringType()), T.StructField("p_partkey", T.LongType()),
])


def read_csv_with_schema(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


ENERGY_SCHEMA = T.StructType([T.StructField("Datetime", T.StringType()),
                              T.StructField("AEP_MW", T.DoubleType())])


def read_hourly_energy(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: ``Datetime`` text parsed to TIMESTAMP_NTZ, load as DOUBLE."""
    df = read_csv_with_schema(spark, path, ENERGY_SCHEMA)
    return df.select(F.to_timestamp_ntz(F.col("Datetime"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("Datetime"),
                     "AEP_MW")


def read_first_available(spark: SparkSession, paths, reader) -> DataFrame:
    """SRC5: try candidate paths in order; the first readable one wins."""
    last = None
    for p in paths:
        try:
            df = reader(spark, p)
            df.schema  # noqa: B018  (resolves the path now)
            return df
        except AnalysisException as e:
            last = e
    raise FileNotFoundError(f"none of the candidate paths is readable: {paths}") from last


RATINGS_EMISSION_ALIASES = ["CO2 Emissions(g/km)", "CO2 Emissions (g/km)", "CO2 Rating", "Emissions"]
RATINGS_FUEL_ALIASES = ["Fuel Type", "Fuel", "fuelType"]


def read_fuel_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Fuel-ratings CSV with header; types inferred from a fixed schema of the
    known columns (others read as strings)."""
    header = spark.read.option("header", True).csv(path).columns  # header only: no data job
    fields = []
    for c in header:
        if c in RATINGS_EMISSION_ALIASES:
            fields.append(T.StructField(c, T.DoubleType()))
        elif c == "o_orderkey":
            fields.append(T.StructField(c, T.LongType()))
        else:
            fields.append(T.StructField(c, T.StringType()))
    return read_csv_with_schema(spark, path, T.StructType(fields))


def resolve_ratings(df: DataFrame) -> DataFrame:
    """PRJ2 on the ratings frame: canonical ``fuel_type`` / ``co2_emissions``."""
    from tankwise.operators.patterns import resolve_alias
    em = resolve_alias(df.columns, RATINGS_EMISSION_ALIASES)
    fu = resolve_alias(df.columns, RATINGS_FUEL_ALIASES)
    if em is None or fu is None:
        raise ValueError("fuel ratings lack an emissions or fuel-type column")
    keep = [c for c in df.columns if c not in (em, fu)]
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{fu}`").alias("fuel_type"),
                     F.col(f"`{em}`").alias("co2_emissions"))


# ------------------------------------------------------------------ SRC6
# Fixed default configuration (values equal the reference's defaults).
DEFAULT_CONFIG = {
    "efficiency_thresholds": {
        "Bulldozer": {"good": 0.8, "average": 0.6, "poor": 0.4},
        "Excavator": {"good": 0.8, "average": 0.6, "poor": 0.4},
        "Forklift": {"good": 0.85, "average": 0.7, "poor": 0.5},
        "Loader": {"good": 0.8, "average": 0.6, "poor": 0.4},
        "Truck": {"good": 0.85, "average": 0.7, "poor": 0.5},
        "default": {"good": 0.8, "average": 0.6, "poor": 0.4},
    },
    "maintenance_thresholds": {"service_due_hours": 500, "service_warning_hours": 450},
    "idle_thresholds": {"excessive_idle_minutes": 20, "daily_idle_ratio": 0.3},
    "refuel_thresholds": {"low_fuel_percentage": 20, "optimal_refuel_percentage": 25},
}
CONFIG_SCHEMA = T.StructType([
    T.StructField("efficiency_thresholds", T.MapType(T.StringType(), T.StructType([
        T.StructField("good", T.DoubleType()), T.StructField("average", T.DoubleType()),
        T.StructField("poor", T.DoubleType())]))),
    T.StructField("maintenance_thresholds", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("idle_thresholds", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("refuel_thresholds", T.MapType(T.StringType(), T.DoubleType())),
])


def config_json_text(config: dict | None = None) -> str:
    return json.dumps(config or DEFAULT_CONFIG)


def read_config(spark: SparkSession, path: str | None) -> DataFrame:
    """SRC6: multi-line JSON config; the built-in defaults when no path or an
    unreadable one is given.  One row, nested maps."""
    if path:
        try:
            df = spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(path)
            df.schema  # noqa: B018
            return df
        except AnalysisException:
            pass
    return spark.createDataFrame([_floats(json.loads(config_json_text()))], CONFIG_SCHEMA)


def _floats(x):
    """JSON numbers as floats (the config schema holds DOUBLE values)."""
    if isinstance(x, dict):
        return {k: _floats(v) for k, v in x.items()}
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return float(x)
    return x


def efficiency_thresholds(config: DataFrame) -> DataFrame:
    """Config -> threshold dimension ``(equipment_type, good, average, poor)``."""
    return config.select(F.explode("efficiency_thresholds").alias("equipment_type", "t")).select(
        "equipment_type", "t.good", "t.average", "t.poor")


def scalar_thresholds(config: DataFrame) -> DataFrame:
    """Config -> long table ``(section, name, value)`` of scalar thresholds."""
    parts = []
    for sec in ("maintenance_thresholds", "idle_thresholds", "refuel_thresholds"):
        parts.append(config.select(F.lit(sec).alias("section"),
                                   F.explode(sec).alias("name", "value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ SNK2 / SNK4
def write_lookup_json(df: DataFrame, group: str, key: str, value: str, path: str) -> None:
    """SNK2: one JSON object per group: ``{group: {key: value, ...}}``.

    Keys are written as integers' text (defect Q3 fixed: no ``"0.0"`` keys).
    """
    g = df.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct(
        F.col(key).cast("string"), F.col(value)))).alias("lookup"))
    g.write.mode("overwrite").json(path)


def read_lookup_json(spark: SparkSession, path: str, group: str) -> DataFrame:
    schema = T.StructType([T.StructField(group, T.StringType()),
                           T.StructField("lookup", T.MapType(T.StringType(), T.DoubleType()))])
    df = spark.read.schema(schema).json(path)
    return df.select(group, F.explode("lookup").alias("key", "value")).withColumn(
        "key", F.col("key").cast("int"))


def write_table(df: DataFrame, path: str, partition_by=None) -> None:
    """SNK1/SNK4 default: Parquet, optionally partitioned (e.g. by date or
    priority) so later reads prune partitions."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)
