"""Structured Streaming forms: too many attempts, expiring idempotency keys, late feeds, decided batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import expiring


def attempts_window(attempts: DataFrame, window: str = "15 minutes", slide: str | None = None, watermark: str | None = "1 hour", most: int = 5) -> DataFrame:
    """attempts: order_id, ts. Windows in which an order has more than ``most`` attempts."""
    rows = attempts.withWatermark("ts", watermark) if watermark and attempts.isStreaming else attempts
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return rows.groupBy("order_id", w.alias("w")).agg(F.count("*").alias("attempts")).where(F.col("attempts") > most).select("order_id", F.col("w.start").alias("window_start"), "attempts")


def let_through(requests: DataFrame, ttl: str = "24 hours", delay: str = "24 hours") -> DataFrame:
    """requests: merchant_id, key, ts. merchant_id, key, ts of those whose key let no request through within its time to live before them.

    The time counts from the request that was let through: a repeat does not prolong it. Of equal times one
    passes, rows without a time none. Batches and streams have the same rows, in whatever order a stream brings
    them within ``delay``; it gives each once its watermark is past it.
    """
    if requests.isStreaming:
        return expiring.streamed(requests, ttl, delay)
    return expiring.batched(requests, ttl).select("merchant_id", "key", F.timestamp_micros("us").alias("ts"))


def unique_requests(requests: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """requests: merchant_id, key, ts. Whole rows of let_through(); of equal times the first in the order of their JSON.

    A stream answers at once, in the order of arrival; let_through() waits for the order of time.
    """
    if requests.isStreaming:
        return requests.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["merchant_id", "key"])
    let = expiring.batched(requests, ttl).select(F.col("merchant_id").alias("m"), F.col("key").alias("k"), F.col("us").alias("at"))
    same = W.partitionBy("merchant_id", "key", "ts").orderBy(F.to_json(F.struct(*requests.columns)))
    once = requests.withColumn("i", F.row_number().over(same)).where("i = 1").drop("i")
    return once.join(let, F.col("merchant_id").eqNullSafe(F.col("m")) & F.col("key").eqNullSafe(F.col("k")) & (F.unix_micros(F.col("ts").cast("timestamp")) == F.col("at")), "left_semi")


def await_feed(claims: DataFrame, feed: DataFrame, delay: str = "2 hours") -> DataFrame:
    """claims (claim_id, ref, ts) with the feed row (txn_id, feed_ref, feed_ts) that comes within the delay; null if none does."""
    c = claims.withWatermark("ts", delay) if claims.isStreaming else claims
    f = feed.withWatermark("feed_ts", delay) if feed.isStreaming else feed
    return c.join(f, (F.col("ref") == F.col("feed_ref")) & (F.col("feed_ts") >= F.col("ts")) & (F.col("feed_ts") <= F.col("ts") + F.expr(f"interval {delay}")), "leftOuter")


def decide_stream(claims: DataFrame, decide: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, str], None], checkpoint: str):
    """Decides each micro-batch against the tables as they are then; the batch id makes the sink's writes repeatable."""

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(decide(batch), f"stream-{batch_id:012d}")

    return claims.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
