"""Sharding by jump consistent hashing, in DataFrame functions only.

A document's shard follows from its key and the number of shards: there is no
ring or table. Appending a shard moves only the rows that land in it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import table

#: Rows for each task that numbers slots.
ROWS_PER_BUCKET = 50_000


def jump_hash(key: Column, shards: int) -> Column:
    """Jump consistent hash of a long (or null) to 0..shards-1.

    From bucket b the next jump goes to floor((b + 1) / u), u uniform in (0, 1]
    from xxHash64 of (key, number of the jump); the last bucket below ``shards``
    is the result. The number of jumps is Poisson-like with mean ln(shards); the
    steps allowed exceed what any key needs (failure odds under 1e-40), and are
    all that can occur for up to 64 shards.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    steps = min(shards, 64 + 8 * math.ceil(math.log(shards + 1)))
    start = F.named_struct(F.lit("b"), F.lit(-1).cast("long"), F.lit("j"), F.lit(0).cast("long"))

    def step(s: Column, i: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, i), 11) + F.lit(1)) / F.lit(float(1 << 53))
        jump = F.floor((s["j"] + 1) / u)
        return F.when(s["j"] < shards, F.named_struct(F.lit("b"), s["j"], F.lit("j"), F.least(jump, F.lit(shards).cast("long")))).otherwise(s)

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return walk["b"].cast("int")


def shard_rows(docs: DataFrame, shards: int = 16, key_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    size: UTF-8 bytes plus 1; null texts count as empty. A null key has a shard
    like any other. Equal keys share a shard. slot numbers each shard's rows from
    0 without gaps, in the order of bucket, key, checksum and size; rows alike
    in all of these are counted before the shuffle and get adjoining slots, so
    neither a shard nor a repeated row is gathered in one task. Empty input: no rows.
    """
    rows = docs.select(
        F.col(key_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode(text_col, "UTF-8"), F.lit(b""))).alias("text_crc32"),
    ).groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    total = docs.count()
    buckets = max(1, math.ceil(total / rows_per_bucket))
    rows = rows.withColumn("shard", jump_hash(F.col("doc_id"), shards)).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int")
    )
    # Offsets: a row for each shard and bucket, each shard's own window.
    sums = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("m"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("shard", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["shard", "bucket"])
    return placed.select(
        "doc_id", "size", "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(F.col("offset") + F.col("first"), F.col("offset") + F.col("first") + F.col("n") - 1)).alias("slot"),
        jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, key_col: str = "doc_id", shard_col: str = "shard") -> None:
    """Writes docs with all their columns as Parquet, one folder for each shard."""
    docs.withColumn(shard_col, jump_hash(F.col(key_col), shards)).write.partitionBy(shard_col).parquet(path)


def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
