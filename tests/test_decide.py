"""Whole decisions on small hand-made cases and on the derived views."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import aggregates, explain, workflow
from ledgerloom.operators.decide import decide
from ledgerloom.plans import queries as Q

NOW = 1787216700
CLAIM = "claim_id string, merchant_id string, order_id string, amount_minor long, currency string, sender_name string, receiver_name string, reference_id string, occurred_s long, granularity_s int, tz_stated boolean, date_inferred boolean, proof_sha256 string, notes array<string>, observations array<string>, confidences map<string,double>, now_s long"
LEDGER = "txn_id string, merchant_id string, amount_minor long, currency string, occurred_s long, sender_name string, receiver_name string, external_id string, source string"


def claim(i, **k):
    base = dict(claim_id=i, merchant_id="M", order_id="O" + i, amount_minor=150000, currency="PKR", sender_name="Zulqarnain Qureshi", receiver_name=None, reference_id="TID: EP123456", occurred_s=NOW, granularity_s=60, tz_stated=False, date_inferred=False, proof_sha256="p" + i, notes=[], observations=[], confidences={}, now_s=NOW)
    return tuple((base | k).values())


@pytest.fixture(scope="module")
def decided(spark):
    ledger = [("T1", "M", 150000, "PKR", NOW + 20, "Zulqarnain Qureshi", "Shop", "EP123456", "MERCHANT_LEDGER")]
    ledger += [(f"F{i}", "M", 777 + i, "PKR", NOW - 10_000_000 + i, f"{n} {m}", "Shop", f"ZZ{i:06d}", "MERCHANT_LEDGER") for i, (n, m) in enumerate([("sana", "raza"), ("tariq", "javed"), ("nadia", "iqbal")] * 4)]
    ledger += [("CSV", "N", 9900, "PKR", NOW, "sana raza", "x", "CC999999", "MERCHANT_CSV")]
    claims = [
        claim("ok"), claim("inflated", amount_minor=1500000, proof_sha256="q"), claim("reused", proof_sha256="used"), claim("alone", merchant_id="NOBODY"),
        claim("doubt", confidences={"amount": 0.5}), claim("csv", merchant_id="N", amount_minor=9900, sender_name="sana raza", reference_id="CC999999"),
        claim("nulls", amount_minor=None, sender_name=None, reference_id=None, occurred_s=None, granularity_s=None, date_inferred=None, tz_stated=None, proof_sha256=None, order_id=None, notes=None, observations=None, confidences=None),
        claim("other", sender_name="Imran Baig"),
    ]
    orders = [("Ook", 150000, "PKR"), ("Oinflated", 150000, "PKR"), ("Oother", 150000, "PKR")]
    return decide(
        spark.createDataFrame(claims, CLAIM), spark.createDataFrame(orders, "order_id string, expected_minor long, currency string"), spark.createDataFrame(ledger, LEDGER),
        spark.createDataFrame([], "txn_id string, order_id string, verification_id string, allocated_s long"),
        spark.createDataFrame([("used", "Ofirst", None, "v", 1)], "sha256 string, order_id string, order_ref string, verification_id string, submitted_s long"),
    ).cache()


def test_rules_fire(decided):
    got = {r["claim_id"]: r for r in decided.collect()}
    want = {"ok": "R090", "inflated": "R030", "reused": "R025", "alone": "R010", "doubt": "R067", "csv": "R065", "other": "R075"}
    assert {k: got[k]["fired_rule_id"] for k in want} == want
    assert got["ok"]["matched_txn_id"] == "T1" and got["ok"]["status"] == "VERIFIED" and got["ok"]["confidence"] == 1.0
    assert got["reused"]["matched_txn_id"] is None and "PROOF_PREVIOUSLY_SUBMITTED:Ofirst" in got["reused"]["observations"]
    assert "CLAIM_INFLATED_ROUND" in got["inflated"]["observations"] and got["nulls"]["status"] != "VERIFIED"
    assert all(r["violation"] is None for r in got.values()) and len(got) == 8


def test_explained(decided):
    got = {r["claim_id"]: r for r in explain.explain(decided).collect()}
    assert got["ok"]["summary"].startswith("Rs 1,500 received.\nTransaction T1 matches")
    assert got["reused"]["summary"] == "This same screenshot was already used for order Ofirst." and got["reused"]["action"].startswith("Do not approve the order. Ask")
    assert got["inflated"]["summary"] == "The screenshot claims Rs 15,000, but Rs 1,500 was received."
    assert got["other"]["summary"] == "The sender name does not match the transaction this receipt otherwise points to."
    assert "Screenshot: Rs 1,500\nReceived:   Rs 1,500" in got["ok"]["text"]


def test_workflow(decided, spark):
    none = spark.createDataFrame([], "txn_id string, order_id string")
    new = workflow.approve(decided, none).collect()
    assert [(r["txn_id"], r["order_id"]) for r in new] == [("T1", "Ook")]
    assert workflow.approve(decided, spark.createDataFrame([("T1", "x")], "txn_id string, order_id string")).count() == 0
    evidence = workflow.stored_evidence(decided)
    back = {r["claim_id"]: r for r in workflow.rehydrate(evidence, decided).collect()}
    assert back["ok"]["fired_rule_id"] == "PERSISTED" and {e["agreement"] for e in back["ok"]["evidence"]} == {"AGREE"}
    assert aggregates.dashboard(decided).first()["by_status"]["VERIFIED"] == 1


def test_every_rule_fires_on_the_views(spark, sf):
    core = Q.decided_core(spark, sf).groupBy("fired_rule_id").count().collect()
    assert {"R010", "R020", "R030", "R040", "R050", "R060", "R065", "R070", "R072", "R080", "R090", "R999"} <= {r["fired_rule_id"] for r in core}


def test_partitioning_does_not_matter(spark, sf):
    a = Q.decided_core(spark, sf).select("claim_id", "status", "best_score", F.array_join("reasons", "|").alias("r"))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        b = Q.decided_core(spark, sf).select("claim_id", "status", "best_score", F.array_join("reasons", "|").alias("r"))
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
