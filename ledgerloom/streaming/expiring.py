"""Keys with a time to live: which requests pass, in batches and in streams, by the same rule."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def micros(spark: SparkSession, interval: str) -> int:
    """An interval of a fixed length ('24 hours') in microseconds."""
    return spark.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {interval}"))).first()[0]


def passing(times: np.ndarray, due: int | None, ttl: int) -> tuple[list[int], int | None]:
    """Places of those of the ascending times that pass, and from when the next may; due: None before the first."""
    out, at = [], 0
    while True:
        at = at if due is None else int(np.searchsorted(times, due, "left"))
        if at >= len(times):
            return out, due
        out.append(at)
        due = int(times[at]) + ttl


def batched(requests: DataFrame, ttl: str) -> DataFrame:
    """merchant_id, key, us (microseconds) of the requests that pass.

    Sorted runs stream through their tasks, which hold one batch and one time: a
    key of any length fits, though it is read by one task.
    """
    span = micros(requests.sparkSession, ttl)
    rows = requests.where("ts is not null").select("merchant_id", "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).distinct()
    group = F.to_json(F.array(F.col("merchant_id").cast("string"), F.col("key").cast("string"))).alias("g")
    sorted_rows = rows.select(group, "merchant_id", "key", "us").repartition("g").sortWithinPartitions("g", "us")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, due = None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys, us = b.column(0).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            taken: list[int] = []
            for a, z in zip(starts[:-1], starts[1:], strict=True):
                due = due if keys[a] == open_key else None
                open_key = keys[a]
                places, due = passing(us[a:z], due, span)
                taken += [int(a) + p for p in places]
            yield b.take(pa.array(taken, pa.int64())).select([1, 2, 3])

    return sorted_rows.mapInArrow(scan, T.StructType([*requests.select("merchant_id", "key").schema, T.StructField("us", T.LongType())]))


def streamed(requests: DataFrame, ttl: str, delay: str) -> DataFrame:
    """merchant_id, key, ts of the requests that pass, in the order of their times whatever order they come in.

    A key's state holds the times that the watermark has not passed yet and from
    when the next request may pass; it ends when its time to live has.
    """
    span = micros(requests.sparkSession, ttl)
    rows = requests.where("ts is not null").select("merchant_id", "key", "ts").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withWatermark("ts", delay)
    out = T.StructType([*requests.select("merchant_id", "key").schema, T.StructField("us", T.LongType())])

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, waiting = state.get if state.exists else (None, [])
        waiting = {int(x) for x in waiting}
        for f in frames:
            waiting |= {int(x) for x in f["us"]}
        now_ms = state.getCurrentWatermarkMs()
        ready = np.array(sorted(x for x in waiting if x <= now_ms * 1000), dtype=np.int64)
        places, due = passing(ready, None if due is None else int(due), span)
        waiting = sorted(waiting - set(ready.tolist()))
        if waiting or (due is not None and due > now_ms * 1000):
            state.update((due, waiting))
            state.setTimeoutTimestamp(max((waiting[0] if waiting else due) // 1000 + 1, now_ms + 1))
        elif state.exists:
            state.remove()
        if places:
            yield pd.DataFrame({"merchant_id": [key[0]] * len(places), "key": [key[1]] * len(places), "us": ready[places]})

    kept = rows.groupBy("merchant_id", "key").applyInPandasWithState(step, out, "due long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.select("merchant_id", "key", F.timestamp_micros("us").alias("ts"))
