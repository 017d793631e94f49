"""Near images, coverage and tables in versions."""

from __future__ import annotations

import random

import duckdb
import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.operators import images, reports, workflow
from ledgerloom.plans import queries as Q
from ledgerloom.sources.snapshots import Conflict, Snapshots

DECIDED = "claim_id string, status string, matched_txn_id string, order_id string, now_s long"


@pytest.mark.parametrize("name", ["rule_coverage", "proof_memory"])
def test_query_equals_sql(name, spark, sf, duck):
    got, want = Q.QUERIES[name](spark, sf).toPandas(), duck.sql(Q.ORACLE[name]).df()
    assert rows(got) == rows(want) and len(got)


def test_near_images_equal_sql(spark):
    at = "/root/testdata/sf0.1"  # the smaller tables have no pair so near
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet'")
    got = Q.QUERIES["near_images"](spark, at).toPandas()
    assert rows(got) == rows(c.sql(Q.ORACLE["near_images"]).df()) and len(got)


@pytest.mark.parametrize("bits, distance, share", [(64, 8, 1), (64, 8, 2), (256, 8, 1), (256, 20, 1), (64, 0, 1), (64, 3, 3)])
def test_near_images_equal_brute_force(spark, bits, distance, share):
    rng = random.Random(bits + distance + share)
    hashes = [rng.getrandbits(bits) for _ in range(30)]
    for _ in range(90):  # copies, and others a few bits away
        h = rng.choice(hashes)
        for b in rng.sample(range(bits), rng.randrange(0, distance + 4)):
            h ^= 1 << b
        hashes.append(h)
    hashes += [0, 0, (1 << bits) - 1, 1]
    made = [(i, f"{h:0{bits // 4}x}") for i, h in enumerate(hashes)] + [(-1, None)]
    df = spark.createDataFrame(made, "id long, h string")
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    own = sorted(first.items(), key=lambda x: x[1])
    want = sorted((i, j, (a ^ b).bit_count()) for n, (a, i) in enumerate(own) for b, j in own[n + 1 :] if (a ^ b).bit_count() <= distance)
    assert sorted(map(tuple, images.near_classes(df, "id", "h", distance, bits, share).collect())) == want
    assert dict(map(tuple, images.image_classes(df, "id", "h").collect())) == {i: first[h] for i, h in enumerate(hashes)}


def test_near_images_refuse(spark):
    df = spark.createDataFrame([(1, "ff")], "id long, h string")
    for distance, bits, share in [(-1, 64, 1), (8, 60, 1), (8, 64, 0), (64, 64, 1), (16, 64, 8)]:
        with pytest.raises(ValueError):
            images.near_classes(df, "id", "h", distance, bits, share)
    with pytest.raises(Exception, match="not a hash of 64 bits"):
        images.near_classes(df, "id", "h", 8).collect()
    assert images.near_classes(df.limit(0), "id", "h", 8).count() == 0


def test_difference_hash(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0, 0.0] * 2,), ([],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(images.difference_hash(F.col("v"))).collect()] == ["99", None, None]


def test_coverage_of_nothing_and_of_the_unexpected(spark):
    d = spark.createDataFrame([("C1", "R777", "VERIFIED", ["ODD", "AMOUNT_EXACT"]), ("C2", "R999", "NEEDS_REVIEW", [])], "claim_id string, fired_rule_id string, status string, reasons array<string>")
    got = {(r.level, r.rule or r.reason or r.status): (r.claims, r.expected) for r in reports.coverage(d).collect()}
    assert got["rule", "R777"] == got["reason", "ODD"] == (1, False) and got["reason", "AMOUNT_EXACT"] == (1, True)
    assert got["total", None] == (2, True) and got["rule", "R010"] == (0, True) and got["status", "VERIFIED"] == (1, True)
    none = reports.coverage(d.limit(0)).collect()
    assert {r.claims for r in none} == {0} and all(r.expected for r in none) and len(none) == 15 + 5 + 18 + 1


def approval(*pairs):
    return [(c, "VERIFIED", t, o, s) for c, t, o, s in pairs]


def test_versions_conflict(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    one = spark.createDataFrame([(1,)], "a long")
    assert s.latest() == 0 and s.read("x", "a long").count() == 0
    assert s.commit(0, append={"x": one}) == 1
    with pytest.raises(Conflict):
        s.commit(0, append={"x": one})
    assert s.latest() == 1 and s.read("x", "a long").count() == 1  # the loser's folder is in no version
    s.commit(1, append={"x": one}, replace={"y": one})
    assert [s.read("x", "a long", v).count() for v in (0, 1, 2)] == [0, 1, 2] and s.read("y", "a long").count() == 1
    s.commit(2, replace={"x": None})
    assert s.read("x", "a long").count() == 0 and s.read("x", "a long", 2).count() == 2


def test_interleaved_approvals_have_one_winner(spark, tmp_path):
    a = spark.createDataFrame(approval(("A1", "T1", "O1", 5), ("A2", "T2", "O2", 5)), DECIDED)
    b = spark.createDataFrame(approval(("B1", "T1", "O9", 1), ("B2", "T9", "O2", 1), ("B3", "T3", "O3", 1)), DECIDED)
    other = Snapshots(spark, str(tmp_path))

    class Slow(Snapshots):
        tries = 0

        def commit(self, base, **k):
            Slow.tries += 1
            if Slow.tries == 1:
                workflow.approve_into(other, b)  # comes in between what was read and what is written
            return super().commit(base, **k)

    assert workflow.approve_into(Slow(spark, str(tmp_path)), a) == 2 and Slow.tries == 2
    got = {r.verification_id for r in other.read("allocations", workflow.ALLOCATION).collect()}
    assert got == {"B1", "B2", "B3"}
    workflow.approve_into(other, spark.createDataFrame(approval(("C1", "T4", "O4", 9), ("C2", "T4", "O5", 8)), DECIDED))
    assert {r.verification_id for r in other.read("allocations", workflow.ALLOCATION).collect()} == {"B1", "B2", "B3", "C2"}


def test_pending_approved_and_reset(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    make = lambda *r: spark.createDataFrame(list(r), workflow.PROOF)
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "verification_id string")
    workflow.record_pending(s, make(("M", "p1", "O1", "SHOP-1", "V1", 10), ("M", "p2", "O2", None, "V2", 11), ("N", "p1", "O3", None, "V3", 12), ("M", None, "O4", None, "V4", 1)))
    workflow.record_pending(s, make(("M", "p9", "O1", None, "V1", 20)))  # the same submission, derived again
    workflow.approve_pending(s, ids("V1", "V3", "unknown"))
    accepted = lambda: sorted((r.merchant_id, r.sha256, r.verification_id) for r in s.read("accepted", workflow.PROOF).collect())
    assert accepted() == [("M", "p9", "V1"), ("N", "p1", "V3")]
    workflow.record_pending(s, make(("M", "p9", "O7", None, "V7", 0)))
    workflow.approve_pending(s, ids("V7", "V1"))  # the first acceptance stays; V1 was consumed
    assert accepted() == [("M", "p9", "V1"), ("N", "p1", "V3")]
    assert [r.verification_id for r in s.read("pending", workflow.PROOF).collect()] == ["V2"]
    workflow.reset_proofs(s)
    assert accepted() == [] and s.read("pending", workflow.PROOF).count() == 0
