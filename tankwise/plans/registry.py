"""Registry of named jobs: a Spark builder and, where SQL can express it, the
equivalent DuckDB SQL (the correctness oracle).

Builders take ``(spark, sf_dir)`` and return a DataFrame whose double columns
are rounded to ``DIGITS`` after all arithmetic and whose nested columns are
dropped (nested values are covered by unit tests).  Oracle SQL rounds the same
columns with the same digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankwise.sources.tables import ECONOMY_SQL, FUEL_RATINGS_SQL, TELEMETRY_SQL

DIGITS = 4
QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate key {key}")

        def run(spark, sf_dir):
            prepare(spark)
            return finalize(fn(spark, sf_dir))
        run.__name__ = f"q_{key}"
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def prepare(spark) -> None:
    """Jobs may run in a caller's session: make sure the shared checkpoint
    folder is known, Python workers can import the package, and event-time casts use UTC (telemetry is zone-less)."""
    from tankwise.session import ensure_checkpoint_dir, ship_package
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def finalize(df: DataFrame) -> DataFrame:
    """Round doubles, drop nested columns (comparison shape)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            continue
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_digits(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def round_digits(c):
    """``round(c * 10^d) / 10^d``: the same IEEE steps in Spark and DuckDB, so
    near-ties round identically in both engines."""
    scale = float(10 ** DIGITS)
    r = F.round(c * F.lit(scale)) / F.lit(scale)
    # -0.0 and 0.0 compare equal but hash differently: emit +0.0.
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


# ------------------------------------------------------------------ SQL helpers
TELEMETRY_CTE = "t AS (" + TELEMETRY_SQL.replace("{events}", "events") + ")"

ECONOMY_CTE = "econ AS (" + ECONOMY_SQL.replace("{part}", "part") + ")"
RATINGS_CTE = "ratings AS (" + FUEL_RATINGS_SQL.replace("{orders}", "orders") + ")"

TELEMETRY_DOUBLES = ["fuel_level", "fuel_consumed", "tank_capacity", "idle_time", "load_pct", "rpm",
                     "speed", "distance", "fuel_price", "ambient_temp", "engine_temp",
                     "oil_pressure", "throttle", "battery_voltage", "emission_rate",
                     "fuel_efficiency", "hours_since_service"]


def with_t(body: str, *ctes: str) -> str:
    """``WITH t AS (telemetry), <ctes> <body>``."""
    parts = [TELEMETRY_CTE, *ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


def with_ctes(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def rnd(sql: str, cols) -> str:
    """Round the named double columns of ``sql``'s result to DIGITS."""
    cols = [c for c in cols]
    if not cols:
        return sql
    scale = f"1e{DIGITS}"
    rep = ", ".join(f"CASE WHEN round({c} * {scale}) = 0 THEN 0e0 ELSE round({c} * {scale}) / {scale} END AS {c}"
                    for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) _r"
