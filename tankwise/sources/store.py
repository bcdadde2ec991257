"""Date-partitioned telemetry store (SRC1, SNK1) and reads that prune it.

Ingest writes the readings by range of (date, unit, time): a hot day or unit is
spread over as many files as it needs, a file holds few dates, and row groups are
narrow in ``equipment_id`` with a Bloom filter on it.  Each date's first and last
time and row count come from the Parquet footers alone (aggregate pushdown) and are
kept beside the data as a table of one row a date.

A store belongs to the state of the table it was read from: its version names the
table's fingerprint, and a changed table is ingested again."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankwise.session import ensure_checkpoint_dir, settings
from tankwise.sources.tables import telemetry
from tankwise.sources.versions import Log, fingerprint

MICROS, DATE = "ts_us", "date"
FORMAT = 2               # of a store's files and record; older ones are written anew
ROW_GROUP = 64 << 20     # bytes that a point lookup has to read at least
STATS = "date date, rows long, first long, last long"
# the aggregate reaches the footers only through the newer file source
FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def write_store(rows: DataFrame, path: str, row_group: int = ROW_GROUP) -> None:
    """Write readings partitioned by date; rows without a time form a partition of
    their own that no trailing window reads."""
    # a file of nulls only has no range in its footer
    d = rows.withColumn(MICROS, F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0))).withColumn(DATE, F.to_date("ts"))
    (d.repartitionByRange(DATE, "equipment_id", MICROS)
     .sortWithinPartitions(DATE, "equipment_id", MICROS, "event_id")
     .write.option("parquet.bloom.filter.enabled#equipment_id", "true").option("parquet.block.size", row_group).partitionBy(DATE).parquet(path))


def date_stats(spark: SparkSession, path: str, schema: T.StructType):
    """Rows ``(date, rows, first, last)`` of a store, from its footers: no data page
    is read.  ``first`` and ``last`` are micros, null for rows without a time."""
    with settings(spark, FOOTERS):
        found = footer_query(spark, path, schema).collect()
    return [tuple(r) if r[DATE] is not None else (None, r["rows"], None, None) for r in found]


def footer_query(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (spark.read.schema(schema).parquet(path).groupBy(DATE)
            .agg(F.count("*").alias("rows"), F.min(MICROS).alias("first"), F.max(MICROS).alias("last")))


@dataclass
class Store:
    """A written store: ``rows`` with its partition column ``date``, and one row a date."""
    spark: SparkSession
    path: str
    stats_path: str
    schema: T.StructType

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).drop(MICROS)

    @property
    def stats(self) -> DataFrame:
        return self.spark.read.schema(STATS).parquet(self.stats_path)

    def last_time(self) -> Column:
        """Scalar subquery: time of the newest reading, from the date table."""
        newest = F.max(F.timestamp_micros("last").cast("timestamp_ntz"))
        return self.stats.agg(newest).scalar()

    def trailing(self, hours: int | None = None, days: int | None = None) -> DataFrame:
        """PRJ9: readings of the last hours or days before the newest one, both ends
        included.  The cut-off is a scalar subquery, so it prunes date folders as the
        scan starts and is pushed to the row groups of the first date left."""
        length = F.make_dt_interval(F.lit(days)) if days is not None else F.make_dt_interval(F.lit(0), F.lit(hours))
        cut = self.last_time() - length
        return self.rows.where((F.col(DATE) >= F.to_date(cut)) & (F.col("ts") >= cut))

    def units(self, ids: list[str]) -> DataFrame:
        """PRJ7: readings of a few units; row groups are skipped by their range and
        Bloom filter on ``equipment_id``."""
        return self.rows.where(F.col("equipment_id").isin([str(i) for i in ids]))


def ingest(rows: DataFrame, folder: str, source: str) -> Store:
    """Write ``rows`` as a new version of the store under ``folder``."""
    spark = rows.sparkSession
    name = uuid.uuid4().hex
    path, stats = f"{folder}/data-{name}", f"{folder}/dates-{name}"
    write_store(rows, path)
    schema = T.StructType([*rows.schema.fields, T.StructField(MICROS, T.LongType()), T.StructField(DATE, T.DateType())])
    found = date_stats(spark, path, schema)         # one row a date
    spark.createDataFrame(found, STATS).coalesce(1).write.parquet(stats)
    Log(spark, f"{folder}/versions").add({"format": FORMAT, "source": source, "data": path, "dates": stats, "schema": schema.jsonValue()})
    return Store(spark, path, stats, schema)


def store_folder(spark: SparkSession, sf_dir: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tankwise/store/{hashlib.sha256(sf_dir.rstrip('/').encode()).hexdigest()[:24]}"


def telemetry_store(spark: SparkSession, sf_dir: str) -> Store:
    """The store of a table folder's telemetry; ingested if there is none yet or if
    the events have changed since."""
    folder = store_folder(spark, sf_dir)
    source = fingerprint(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    _, newest = Log(spark, f"{folder}/versions").latest()
    if newest and newest.get("format") == FORMAT and newest["source"] == source:
        return Store(spark, newest["data"], newest["dates"], T.StructType.fromJson(newest["schema"]))
    return ingest(telemetry(spark, sf_dir), folder, source)


def last_before(store: Store, cut, units: DataFrame, columns: list[str]) -> DataFrame:
    """Each unit's last reading before the time ``cut`` (a datetime), for the units in
    ``units(equipment_id)``.

    Looks back over a week, then twice as far and so on, each time over date folders
    not read before and for units not found yet, until all are found or the store
    begins; a unit with recent readings costs a week, whatever the history."""
    import datetime as dt

    from tankwise.operators.joins import join_checked, materialize_small
    spark = store.spark
    first = store.stats.agg(F.min(DATE)).first()[0]
    high, span = cut.date(), 7
    left = materialize_small(units.select("equipment_id").where("equipment_id is not null").distinct())
    rest = [c for c in columns if c != "equipment_id"]
    found = None
    while first is not None and high >= first and not left.isEmpty():
        low = high - dt.timedelta(days=span)
        part = store.rows.where(F.col(DATE).between(F.lit(low), F.lit(high)) & (F.col("ts") < F.lit(cut).cast("timestamp_ntz")))
        part = join_checked(part.select(*columns), left, "equipment_id", "left_semi", materialize=False)
        last = materialize_small(part.groupBy("equipment_id").agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("r"))
                                 .select("equipment_id", "r.*"))
        found = last if found is None else found.unionByName(last)
        left = materialize_small(left.join(last.select("equipment_id"), "equipment_id", "left_anti"))
        high, span = low - dt.timedelta(days=1), span * 2
    if found is None:
        return spark.createDataFrame([], store.rows.select("equipment_id", *rest).schema)
    return found
