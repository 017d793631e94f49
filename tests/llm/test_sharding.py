from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from ledgerloom.llm import sharding as S


def check(rows, docs):
    assert len(rows) == len(docs)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key" and 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == want


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(S.op6_jump_sharding(spark, sf).collect(), docs)


def test_odd_rows_and_small_buckets(spark):
    docs = [(1, None), (2, ""), (None, "x"), (None, "x"), (3, "é" * 1000), (3, "é" * 1000)] + [(7, "same")] * 50 + [(i, "t") for i in range(10, 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS n", "3 AS bucket")
    check(S.shard_rows(df, rows_per_bucket=7).collect(), docs)
    assert S.shard_rows(df.limit(0)).count() == 0


def test_jump_is_balanced_and_moves_little(spark):
    ids = spark.range(20_000)
    d = ids.select(*[S.jump_hash(F.col("id"), n).alias(f"s{n}") for n in (1, 2, 10, 11)]).toPandas()
    assert (d.s1 == 0).all()
    moved = d[d.s10 != d.s11]
    assert set(moved.s11) == {10} and 0.07 < len(moved) / len(d) < 0.11
    assert d.s10.value_counts().min() > 1800 and d.s10.value_counts().max() < 2200
