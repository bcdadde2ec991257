"""Training-corpus pipeline: quality, toxicity, near duplicates, benchmark
decontamination, piece encoding.

Each stage takes the documents that the one before kept, as Parquet, and its
decisions take effect; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tankwise.llm.decontaminate import decontaminate
from tankwise.llm.ngram_join import ngram_join
from tankwise.llm.piece_codec import MODEL, piece_codec, vocabulary_path
from tankwise.llm.quality import keep_good
from tankwise.llm.shared import BROADCAST_IDS, documents, of_ids, stored
from tankwise.llm.toxicity import held_out, keep_below
from tankwise.plans.registry import prepare

# Trained models, hashed joins and a tokenizer: not expressible in SQL.
ORACLE_SQL = None
TOXIC = 0.5


# Documents are large pages: their Parquet is written by a codec that streams through
# small buffers.
CODEC = "zstd"


def _ready(spark: SparkSession) -> None:
    prepare(spark)
    spark.conf.set("spark.sql.parquet.compression.codec", CODEC)


def _keyed(docs: DataFrame) -> DataFrame:
    """``(record, text, row, own)``: each row of ``docs`` with a key of its own.

    A document whose id no other row has keeps it (``own``).  Rows without an id and
    rows that share one are told apart by id and text: their key is a hash of both,
    below zero.  Only ids are shuffled to find them."""
    again = stored(docs.groupBy("doc_id").count().where("doc_id is null or count > 1").select("doc_id"), "again")
    n = again.count()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), "doc_id", "text")
    if n == 0:
        return rows.select("record", "text", F.col("doc_id").alias("row"), F.lit(True).alias("own"))
    marks = again.select(F.col("doc_id").alias("shared"), F.lit(False).alias("own"))
    marks = F.broadcast(marks) if n <= BROADCAST_IDS else marks
    key = F.xxhash64("doc_id", "text", F.lit("row")).bitwiseOR(F.lit(-(1 << 63)))
    own = F.coalesce("own", F.lit(True))
    return rows.join(marks, F.col("doc_id").eqNullSafe(F.col("shared")), "left").select(
        "record", "text", F.when(own, F.col("doc_id")).otherwise(key).alias("row"), own.alias("own"))


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose key is not in ``gone(row)``."""
    return of_ids(keyed, stored(gone.select("row").distinct(), "gone"), "left_anti", "row")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects (empty texts too)."""
    _ready(spark)
    return keep_good(docs)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity reaches one half."""
    _ready(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(held_out(5) != 0)
    return keep_below(docs, labels, TOXIC)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest key (the smallest
    id, but rows without an id or with a shared one come first).  Texts without words
    are in no group and stay."""
    _ready(spark)
    keyed = _keyed(docs)
    joined = ngram_join(keyed.select(F.col("row").alias("doc_id"), "text"))
    rest = _without(keyed, joined.where("doc_id <> component_id").select(F.col("doc_id").alias("row")))
    # equal rows have one key: the first of them stays
    equal = ~F.col("own") & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return (rest.where(~equal).select("record.*")
            .unionAll(rest.where(equal).dropDuplicates(["row"]).select("record.*")))


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    _ready(spark)
    keyed = _keyed(docs)
    found = decontaminate(keyed.select(F.col("row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(keyed, found.select(F.col("doc_id").alias("row"))).select("record.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and their decoded text, as digests, of what is left."""
    _ready(spark)
    return piece_codec(docs, vocabulary_path(MODEL))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", keep_civil),
    ("near_duplicates", keep_distinct),
    ("decontamination", keep_unseen),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read
    again by the next."""
    _ready(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
