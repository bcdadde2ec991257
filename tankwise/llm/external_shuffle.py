"""Sharding by a two-pass external shuffle (operator 10), DataFrame functions only.

Pass 1 scatters whole records uniformly into memory-sized buckets by a seeded
hash of the row's place and id, so no key, source or group of copies can fill a
bucket.  Pass 2 takes one bucket at a time, permutes it with a Fisher-Yates
shuffle (``shuffle`` over the bucket's array) and writes it.  Bucket sizes give
each record its place in the one global random order; shards deal that order out
in turn, so their counts are at most one apart (law ``rows``).

The permuted buckets are written to the shared folder before places are
assigned: a lost executor repeats a bucket, never half of an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tankwise.llm.shared import documents, stored

SHARDS = 24
SEED = 20240607
BUCKET_BYTES = 24 << 20
BROADCAST_BUCKETS = 500_000   # bucket starts sent to all tasks up to this number (12 bytes each)


def external_shuffle(df: DataFrame, size: F.Column, shards: int = SHARDS, seed: int = SEED,
                     bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(record, shard, slot)``: every row of ``df`` as a struct, its shard and
    its gapless place in it.  ``size`` is a row's size in bytes.

    Any column may be null, rows may repeat (each copy gets a place of its own),
    column names cannot clash as they stay inside ``record``; an empty table
    gives an empty result."""
    total = df.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    place = F.monotonically_increasing_id()
    scattered = (df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"), place.alias("place"))
                 .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(buckets)).cast("int"))
                 .repartitionById(buckets, F.col("bucket")))      # one bucket a partition
    permuted = (scattered.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("place", "record"))).alias("rows"))
                .select("bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("pos", "row"))
                .select("bucket", "pos", F.col("row.record").alias("record")))
    written = stored(permuted, "buckets")
    # one row a bucket: the total over bucket_bytes, small for any table
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (written.groupBy("bucket").agg(F.count("*").alias("n"))
              .select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    at = F.col("start") + F.col("pos")
    starts = F.broadcast(starts) if buckets <= BROADCAST_BUCKETS else starts
    return written.join(starts, "bucket").select(
        "record", (at % shards).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write each shard's records as one folder, in slot order."""
    (shuffled.select("record.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
     .repartition("_shard").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path))


def op10_external_shuffle(spark, sf_dir):
    """All documents in 24 shards, counts at most one apart."""
    text = F.coalesce("text", F.lit(""))
    out = external_shuffle(documents(spark, sf_dir), (F.octet_length(text) + 8).cast("long"))
    text = F.coalesce("record.text", F.lit(""))
    return out.select(F.col("record.doc_id").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                      F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
