"""Tables that a stream changes while others read them.

An upsert table is a base and a list of change sets, all written once and never
altered; a version record names them, and a reader takes one version whole.  An
epoch that is applied twice finds its number in the record and changes nothing.
Change sets are folded into a new base when they hold half as many rows as the base
or are ``MOST`` in number, so a row is rewritten a few times for each change of the
table's size, not for each epoch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankwise.sources.versions import Log, delete

EPOCH = "_epoch"
MOST = 16


class UpsertTable:
    """Rows by ``key``; the row of the highest epoch counts."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: T.StructType | None = None):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.log = Log(spark, f"{self.folder}/versions")
        self.schema = schema

    def _write(self, rows: DataFrame) -> dict:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return {"path": path, "rows": self.spark.read.schema(rows.schema).parquet(path).count()}     # from the footers

    def apply(self, batch: DataFrame, epoch: int) -> bool:
        """Make ``batch`` (one row a key) the newest change; False if the epoch, or a
        later one, is in the table already."""
        number, now = self.log.latest()
        if now is not None and now["epoch"] >= epoch:
            return False
        change = self._write(batch.withColumn(EPOCH, F.lit(epoch).cast("long")))
        changes = [*(now["changes"] if now else []), change]
        record = {"epoch": epoch, "base": now["base"] if now else None, "changes": changes,
                  "schema": batch.schema.jsonValue()}
        held = record["base"]["rows"] if record["base"] else 0
        if len(changes) >= MOST or 2 * sum(c["rows"] for c in changes) > held > 0:
            record = self._folded(record)
        return self.log.commit(number + 1, record)      # False if another writer was faster

    def _sources(self, record: dict) -> list[str]:
        return [p["path"] for p in ([record["base"]] if record["base"] else []) + record["changes"]]

    def _merged(self, record: dict) -> DataFrame:
        schema = T.StructType.fromJson(record["schema"]).add(T.StructField(EPOCH, T.LongType()))
        rows = self.spark.read.schema(schema).parquet(*self._sources(record))
        if not record["changes"]:
            return rows
        rest = [c for c in rows.columns if c != self.key]
        return (rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.col(EPOCH)).alias("r"))
                .select(self.key, "r.*").select(*rows.columns))

    def _folded(self, record: dict) -> dict:
        return {**record, "base": self._write(self._merged(record)), "changes": []}

    def read(self, number: int | None = None) -> DataFrame:
        """The newest version, or version ``number``, as it stands now; later changes do
        not show in what is returned."""
        record = self.log.latest()[1] if number is None else self.log.read(number)
        if record is None:
            if self.schema is None:
                raise ValueError(f"no version yet under {self.folder}")
            return self.spark.createDataFrame([], self.schema)
        return self._merged(record).drop(EPOCH)

    def compact(self) -> None:
        """Fold all change sets into a new base, as a version of its own."""
        number, now = self.log.latest()
        if now and now["changes"]:
            self.log.commit(number + 1, self._folded(now))

    def vacuum(self, keep: int = 2) -> int:
        """Delete what only versions before the last ``keep`` name; readers of these must
        have ended.  Returns the number of deleted sets."""
        numbers = self.log.numbers()
        live = {p for n in numbers[-keep:] for p in self._sources(self.log.read(n))}
        gone = {p for n in numbers[:-keep] for p in self._sources(self.log.read(n))} - live
        for p in sorted(gone):
            delete(self.spark, p)
        return len(gone)


class Published:
    """A small table that is replaced as a whole; readers take the newest version."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = Log(spark, f"{self.folder}/versions")

    def publish(self, rows: DataFrame) -> int:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.log.add({"path": path, "schema": rows.schema.jsonValue()})

    def read(self) -> DataFrame:
        number, now = self.log.latest()
        if now is None:
            raise ValueError(f"nothing published under {self.folder}")
        return self.spark.read.schema(T.StructType.fromJson(now["schema"])).parquet(now["path"])
