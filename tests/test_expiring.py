"""Keys with a time to live: batches against a loop and SQL, streams against batches."""

from __future__ import annotations

import random

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom import streaming
from ledgerloom.plans import queries as Q
from ledgerloom.streaming import expiring

DAY = 24 * 3600
SCHEMA = "merchant_id string, key string, s long"


def timed(df):
    return df.withColumn("ts", F.timestamp_seconds("s"))


def by_loop(made, ttl):
    out, due = set(), {}
    for m, k, s in sorted(((m, k, s) for m, k, s in made if s is not None), key=lambda r: r[2]):
        if s >= due.get((m, k), s):
            out.add((m, k, s))
            due[m, k] = s + ttl
    return out


def made(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(["M", "N", None]), rng.choice(["a", "b", None, "lone" + str(rng.random())]), rng.choice([None, rng.randrange(0, 30 * DAY), rng.randrange(0, 3 * DAY)])) for _ in range(n)]


def test_passing():
    times = np.array([0, 1, 9, 10, 12, 25])
    assert expiring.passing(times, None, 10) == ([0, 3, 5], 35)
    assert expiring.passing(times, 11, 10) == ([4, 5], 35) and expiring.passing(times, 99, 10) == ([], 99)
    assert expiring.passing(times[:0], None, 10) == ([], None)


def test_batches_equal_a_loop(spark):
    data = made(3_000, 1)
    got = streaming.unique_requests(timed(spark.createDataFrame(data, SCHEMA))).collect()
    assert len(got) == len({(r.merchant_id, r.key, r.s) for r in got})
    assert {(r.merchant_id, r.key, r.s) for r in got} == by_loop(data, DAY)
    short = streaming.let_through(timed(spark.createDataFrame(data, SCHEMA)), "3 hours").select("*", F.unix_seconds("ts").alias("s")).collect()
    assert {(r.merchant_id, r.key, r.s) for r in short} == by_loop(data, 3 * 3600)


def test_batches_of_nothing_and_ties(spark):
    none = timed(spark.createDataFrame([], SCHEMA))
    assert streaming.unique_requests(none).count() == 0
    tied = spark.createDataFrame([("M", "k", 5, x) for x in ("b", "a", "c")], SCHEMA + ", what string")
    assert [r.what for r in streaming.unique_requests(timed(tied)).collect()] == ["a"]


def test_query_equals_sql(spark, sf, duck):
    got = Q.QUERIES["requests_let_through"](spark, sf).toPandas()
    assert rows(got) == rows(duck.sql(Q.ORACLE["requests_let_through"]).df()) and len(got)


def test_streams_equal_batches_out_of_order(spark, tmp_path):
    data = [(m, k, s) for m, k, s in made(400, 2) if s is not None and (k or "").startswith("lone") is False]
    late = random.Random(3)
    arrived = sorted(data, key=lambda r: r[2] + late.randrange(0, 2 * 3600))  # up to two hours out of order
    end = [("END", "end", 90 * DAY), ("END", "end", 99 * DAY)]
    for i in range(0, len(arrived), 100):
        timed(spark.createDataFrame(arrived[i : i + 100], SCHEMA)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for e in end:
        timed(spark.createDataFrame([e], SCHEMA)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.let_through(stream, "24 hours", "3 hours").writeStream.format("memory").queryName("let_through").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(150)
    got = [(r.merchant_id, r.key, r.s) for r in spark.table("let_through").select("*", F.unix_seconds("ts").alias("s")).collect() if r.merchant_id != "END"]
    assert len(got) == len(set(got)) and set(got) == by_loop(data, DAY)
