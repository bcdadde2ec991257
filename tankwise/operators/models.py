"""Versioned model registry (SNK3, ML2-ML7).

A version of a model ties together what scoring needs: fitted pipelines, tables
(trees, scalers, cut-offs, training rows), the list of features in order and the
settings, with the fingerprint of the data it was trained on.  Parts are written
first and named by a version record afterwards, so a reader never sees half of a
model; a changed table or other settings find no version and are trained anew."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tankwise.sources.versions import Log


@dataclass
class Model:
    """One version: its parts as tables and pipelines, and what it was made from."""
    version: int
    kind: str
    source: str
    settings: dict
    features: list[str]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    pipelines: dict[str, PipelineModel] = field(default_factory=dict)


class ModelRegistry:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def log(self, kind: str) -> Log:
        return Log(self.spark, f"{self.folder}/{kind}/versions")

    def stage(self, kind: str, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """A table of a version to come, written where versions are; ``publish`` names it
        without writing it again."""
        path = f"{self.folder}/{kind}/{uuid.uuid4().hex}"
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path
        return out

    def publish(self, kind: str, source: str, settings: dict, features: list[str], tables: dict[str, DataFrame] | None = None,
                pipelines: dict[str, PipelineModel] | None = None, partition_by: dict[str, str] | None = None) -> Model:
        """Write all parts and add a version that names them; returns it as a reader
        would load it.  ``partition_by`` names a folder column for some tables; tables
        from ``stage`` are in place already."""
        base = f"{self.folder}/{kind}/{uuid.uuid4().hex}"
        record = {"source": source, "settings": settings, "features": list(features), "tables": {}, "pipelines": {}}
        for name, df in (tables or {}).items():
            path = getattr(df, "_staged_at", None)
            if path is None:
                path, w = f"{base}/{name}", df.write
                column = (partition_by or {}).get(name)
                (w.partitionBy(column) if column else w).parquet(path)
            record["tables"][name] = {"path": path, "schema": df.schema.jsonValue()}
        for i, (name, model) in enumerate(sorted((pipelines or {}).items())):
            model.write().save(f"{base}/pipeline-{i}")
            record["pipelines"][name] = f"{base}/pipeline-{i}"
        return self.load(kind, self.log(kind).add(record))

    def load(self, kind: str, version: int) -> Model:
        r = self.log(kind).read(version)
        return Model(version, kind, r["source"], r["settings"], r["features"],
                     {n: self.spark.read.schema(T.StructType.fromJson(t["schema"])).parquet(t["path"]) for n, t in r["tables"].items()},
                     {n: PipelineModel.load(p) for n, p in r["pipelines"].items()})

    def find(self, kind: str, source: str, settings: dict, features: list[str] | None = None) -> Model | None:
        """The newest version trained on this state of the data with these settings (and
        these features, in this order)."""
        log = self.log(kind)
        for version in reversed(log.numbers()):
            r = log.read(version)
            if r["source"] == source and r["settings"] == settings and (features is None or r["features"] == list(features)):
                return self.load(kind, version)
        return None
