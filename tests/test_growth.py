"""What is shuffled and kept grows with the input, not with the pairs that a dense key has."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ledgerloom.operators import blocking as B
from ledgerloom.operators import decide as D
from ledgerloom.operators import explain, sweep
from ledgerloom.plans import queries as Q
from ledgerloom.policy import DEFAULT
from ledgerloom.storage import Tables

CLAIM = "claim_id string, merchant_id string, amount_minor long, currency string, sender_name string, receiver_name string, reference_id string, occurred_s long, now_s long"
LEDGER = "txn_id string, merchant_id string, amount_minor long, currency string, occurred_s long, sender_name string, receiver_name string, external_id string"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_dense_line_gives_the_nearest_alone(spark):
    """Ties beyond the number wanted, rows of several blocks and slots, claims before, between and after them."""
    rows = [("T%04d" % (i * 7919 % 1000), [None, "M"][i % 3 > 0], 10_000 + i // 9 * 60, 5) for i in range(900)] + [("X%02d" % i, "M", 13_000, 5) for i in range(40)]
    claims = [("C%03d" % i, [None, "M", "N"][i % 3], 9_000 + i * 130) for i in range(80)]
    c = spark.createDataFrame([(i, m, t, B.TIME, "") for i, m, t in claims], "claim_id string, cm string, at long, ckind int, ckey string")
    t = spark.createDataFrame([(i, m, at, B.TIME, "") for i, m, at, _ in rows], "txn_id string, tm string, at long, tkind int, tkey string")
    for most, window in ((1, 10**6), (4, 10**6), (25, 900)):
        got: dict = {}
        for r in B.near_hits(c, t, window, most, True, sift=False).collect():
            got.setdefault(r.claim_id, []).append((r.abs_delta, r.txn_id))
        for claim, m, at in claims:
            lines = [[x for x in rows if m is None or x[1] == m], [x for x in rows if m is not None and x[1] is None]]
            want = [x for line in lines for x in sorted((abs(x[2] - at), x[0]) for x in line)[:most] if x[0] <= window]
            assert sorted(got.get(claim, [])) == sorted(want)


def test_full_windows_ask_for_no_later_kind(spark, sf):
    v = Q.views(spark, sf)
    c, t = D.anchored(v["claims"]), Q.settled(v)
    band = Tables(spark).write(B.count_in_band(c, t, DEFAULT.time_window_s, False), "band")
    few = B._open(c, band, 2)
    assert 0 < few.count() < c.count()
    assert few.join(band.where("in_band >= 2"), "claim_id").count() == 0


def test_references_come_once_with_their_narrowest_kind(spark):
    c = spark.createDataFrame([("C1", "M", 1, "PKR", None, None, "EP00123456", 5, 5), ("C2", None, 1, "PKR", None, None, "O12", 5, 5), ("C3", "M", 1, "PKR", None, None, "ZZ123456", None, 9)], CLAIM)
    t = spark.createDataFrame([("T1", "M", 1, "PKR", 9, None, None, "EP00123456"), ("T2", None, 1, "PKR", 9, None, None, "EPO0123456"), ("T3", "M", 1, "PKR", None, None, None, "JC99123456"), ("T4", "N", 1, "PKR", 9, None, None, "012"), ("T5", "N", 1, "PKR", 9, None, None, "EP00123456")], LEDGER)
    got = B.ref_hits(D.anchored(c), t, True).collect()
    assert len(got) == len({(r.claim_id, r.txn_id) for r in got})
    assert {(r.claim_id, r.txn_id): (r.kind, r.abs_delta) for r in got} == {
        ("C1", "T1"): (0, 4), ("C1", "T2"): (1, 4), ("C1", "T3"): (2, None), ("C2", "T4"): (1, 4), ("C3", "T1"): (2, 0), ("C3", "T2"): (2, 0), ("C3", "T3"): (2, None),
    }


def test_keys_that_the_same_names_have_are_one(spark):
    c = D.anchored(spark.createDataFrame([("C", "M", 1, "PKR", "zulqarnain qureshi", None, None, 5, 5)], CLAIM))
    t = spark.createDataFrame([("T1", "M", 1, "PKR", 5, "zulqarnain qureshi", "corner store", None), ("T2", "M", 1, "PKR", 5, "zulqarnain malik", None, None)], LEDGER)
    keyed = Tables(spark).write(B.name_table(c, t, DEFAULT), "keys")
    fewer = B.fewest_keys(c, keyed)
    assert keyed.select("name_key").distinct().count() > 4 and fewer.select("name_key").distinct().count() == 2
    got = B.retrieve(c, t, replace(DEFAULT, max_candidates=1)).collect()
    assert [(r.txn_id, r.examined) for r in got] == [("T1", 2)]


def test_pairs_carry_what_is_compared(spark, sf):
    v = Q.views(spark, sf)
    c, t = D.anchored(v["claims"]), Q.settled(v)
    pairs = D.candidate_pairs(c, t, DEFAULT, False)
    assert "t_amount" in pairs.schema["r"].dataType.names
    table = Tables(spark).write(pairs, "pairs")
    scans = lambda p: plan(D.best_candidates(c, t, p, DEFAULT, False)).count("Relation [")
    assert scans(table) < scans(table.drop("r"))
    assert sorted(map(repr, D.score_candidates(c, t, table, DEFAULT, False).select("claim_id", "txn_id", "score").collect())) == sorted(map(repr, D.score_candidates(c, t, table.drop("r"), DEFAULT, False).select("claim_id", "txn_id", "score").collect()))


def test_names_are_compared_once(spark, sf):
    v = Q.views(spark, sf)
    c, t = D.anchored(v["claims"]), Q.settled(v)
    both = Tables(spark).write(D.compare_pairs(c, t, D.candidate_pairs(c, t, DEFAULT)).select("merchant_id", "sender_name", "tn_sender_name"), "both")
    told = D.name_outcomes(both, t, DEFAULT, D.SENDER)["sender_name"]
    assert told.count() == both.distinct().count() < both.count() / 2


def test_the_api_reads_decisions_once(spark, sf):
    v = Q.views(spark, sf)
    d = Tables(spark).write(D.decide(v["claims"], v["expected"], Q.settled(v), Q.tables.active_allocations(v["allocations"]), v["proofs"], names=False), "decided")
    assert plan(explain.api_result(d)).count("Relation [") == 1


def test_pairs_of_names_and_times_come_once_without_a_distinct(spark, sf):
    for name in ("join_name_key", "join_time_band"):
        found = Q.QUERIES[name](spark, sf)
        assert "Aggregate [claim_id" not in plan(found)
        assert found.count() == found.distinct().count()


def test_ids_that_repeat_give_a_pair_once(spark):
    c = spark.createDataFrame([("C", "M", 1, "PKR", "sana raza", None, None, 60, 60), ("C", None, 1, "PKR", "sana raza", None, None, 90, 60), ("D", "M", 1, "PKR", "sana raza", None, None, 60, 60)], CLAIM)
    t = spark.createDataFrame([("T", "M", 1, "PKR", 50, "sana raza", None, "R"), ("T", "M", 1, "PKR", 70, "sana khan", None, "R"), ("U", None, 1, "PKR", 70, "sana raza", "raza", "R")], LEDGER)
    c = D.anchored(c)
    table = Tables(spark).write(B.by_name(B.name_table(c, t, DEFAULT)), "keys")
    want = {(x, y) for x in "CD" for y in "TU"}
    for find in (lambda c, t: B.band_hits(c, t, 3600), lambda c, t: B.name_hits(c, t, table)):
        got = [tuple(r) for r in B.once(c, t, find).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_policies_are_dealt_out_after_the_last_shuffle(spark, sf):
    """Rows of claims times policies are in no exchange before they are counted."""
    v = Q.views(spark, sf)
    allocations = Q.tables.active_allocations(v["allocations"])
    policies = [DEFAULT, DEFAULT.with_(tau_accept=0.6), DEFAULT.with_(tau_margin=0.3)]
    d = sweep.decide_all(v["claims"], v["expected"], Q.settled(v), allocations, v["proofs"], policies, names=False)
    text = plan(d.groupBy("claim_id").agg(F.collect_list("status").alias("s")))
    lines = text.split("\n")
    dealt = next(i for i, x in enumerate(lines) if "Join Cross" in x)
    assert not any("Join " in x for x in lines[:dealt])
    assert d.count() == 3 * v["claims"].count()
