"""Submitting, approving and storing, for whole batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.snapshots import Snapshots

OUTCOMES = {"AGREE": "PASS", "CONTRADICT": "FAIL", "WEAK": "WARNING", "MISSING": "UNKNOWN"}


def idempotent_submit(requests: DataFrame) -> DataFrame:
    """requests: merchant_id, key, fingerprint, at_s. outcome of each: NEW (the first), REPLAY (alike) or CONFLICT."""
    order = W.partitionBy("merchant_id", "key").orderBy("at_s", "fingerprint")
    first = F.first("fingerprint").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    number = F.row_number().over(order)
    return requests.withColumn("outcome", F.when(number == 1, "NEW").when(F.col("fingerprint") == first, "REPLAY").otherwise("CONFLICT"))


def approve(decided: DataFrame, active: DataFrame) -> DataFrame:
    """New allocations: VERIFIED with transaction and order, the first for each transaction and order, none that is active already."""
    v = decided.where("status = 'VERIFIED' and matched_txn_id is not null and order_id is not null")
    v = v.join(active.select(F.col("txn_id").alias("at")), F.col("matched_txn_id") == F.col("at"), "left_anti")
    v = v.join(active.select(F.col("order_id").alias("ao")), F.col("order_id") == F.col("ao"), "left_anti")
    by_txn = W.partitionBy("matched_txn_id").orderBy("now_s", "claim_id")
    by_order = W.partitionBy("order_id").orderBy("now_s", "claim_id")
    v = v.withColumn("i", F.row_number().over(by_txn)).where("i = 1").withColumn("i", F.row_number().over(by_order)).where("i = 1")
    return v.select(F.col("matched_txn_id").alias("txn_id"), "order_id", F.col("claim_id").alias("verification_id"), F.col("now_s").alias("allocated_s"), F.lit("ACTIVE").alias("status"))


def accept_proofs(decided: DataFrame, known: DataFrame) -> DataFrame:
    """Images of verified claims that no accepted proof has yet; the first claim of each image."""
    v = decided.where("status = 'VERIFIED' and proof_sha256 is not null").join(known.select(F.col("sha256").alias("k")), F.col("proof_sha256") == F.col("k"), "left_anti")
    first = v.withColumn("i", F.row_number().over(W.partitionBy("proof_sha256").orderBy("now_s", "claim_id"))).where("i = 1")
    return first.select(F.col("proof_sha256").alias("sha256"), "order_id", F.lit(None).cast("string").alias("order_ref"), F.col("claim_id").alias("verification_id"), F.col("now_s").alias("submitted_s"))


def accepted_proofs(proofs: DataFrame, attempts: DataFrame, allocations: DataFrame, orders: DataFrame) -> DataFrame:
    """proofs (merchant_id, proof_id, sha256), attempts (merchant_id, proof_id, attempt_id, order_id, decision),
    allocations (attempt_id, status), orders (order_id, order_ref): verified and active ones, the first attempt of each image."""
    a = attempts.where("decision = 'VERIFIED'").join(allocations.where("status = 'ACTIVE'").select("attempt_id"), "attempt_id", "left_semi")
    j = proofs.join(a, ["merchant_id", "proof_id"]).join(orders, "order_id", "left")
    return j.withColumn("i", F.row_number().over(W.partitionBy("merchant_id", "sha256").orderBy("attempt_id"))).where("i = 1").drop("i")


def stored_evidence(decided: DataFrame) -> DataFrame:
    """A row for each piece of evidence as it is stored."""
    e = decided.select("claim_id", F.explode("evidence").alias("e"))
    outcome = F.element_at(F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv]), F.col("e.agreement"))
    return e.select("claim_id", F.col("e.field").alias("field"), F.col("e.code").alias("evidence_code"), outcome.alias("outcome"), F.col("e.score").alias("score"))


def rehydrate(evidence: DataFrame, attempts: DataFrame) -> DataFrame:
    """Stored attempts with their evidence gathered again; the rule reads PERSISTED and one reason survives."""
    back = F.element_at(F.create_map(*[F.lit(x) for k, v in OUTCOMES.items() for x in (v, k)]), F.col("outcome"))
    g = evidence.groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct("field", F.col("evidence_code").alias("code"), back.alias("agreement"), "score"))).alias("evidence"))
    return attempts.select("claim_id", "status", F.slice("reasons", 1, 1).alias("reasons"), F.lit("PERSISTED").alias("fired_rule_id")).join(g, "claim_id", "left")


def valid_override(action, new_status) -> F.Column:
    """OVERRIDDEN exactly when a new status is given."""
    return (action == "OVERRIDDEN") == new_status.isNotNull()


def ingest(transactions: DataFrame) -> DataFrame:
    """Upper-case currency, refused with a reason where the amount is not positive."""
    return transactions.withColumn("currency", F.upper("currency")).withColumn("reject_reason", F.when(F.coalesce(F.col("amount_minor") <= 0, F.lit(True)), "AMOUNT_NOT_POSITIVE"))


ALLOCATION = "txn_id string, order_id string, verification_id string, allocated_s long, status string"
PROOF = "merchant_id string, sha256 string, order_id string, order_ref string, verification_id string, submitted_s long"


def approve_into(store: Snapshots, decided: DataFrame) -> int:
    """approve() against the store's active allocations; batches at the same time yield one winner for each transaction and order.

    decided is read again after a conflict: hand over a written table.
    """

    def step(version: int) -> dict:
        active = store.read("allocations", ALLOCATION, version).where("status = 'ACTIVE'")
        return {"append": {"allocations": approve(decided, active)}}

    return store.update(step)


def _one_each(proofs: DataFrame, *key: str) -> DataFrame:
    """The earliest row of each key; of equal times the least verification, then order, then image."""
    order = W.partitionBy(*key).orderBy(F.col("submitted_s").asc_nulls_last(), "verification_id", "order_id", "sha256")
    return proofs.withColumn("i", F.row_number().over(order)).where("i = 1").drop("i")


def record_pending(store: Snapshots, proofs: DataFrame) -> int:
    """proofs (PROOF) wait for approval. A verification recorded again replaces itself."""
    new = _one_each(proofs.select(*[c.split()[0] for c in PROOF.split(", ")]).where("verification_id is not null and sha256 is not null"), "verification_id")

    def step(version: int) -> dict:
        old = store.read("pending", PROOF, version)
        return {"replace": {"pending": old.join(new.select("verification_id"), "verification_id", "left_anti").unionByName(new)}}

    return store.update(step)


def approve_pending(store: Snapshots, approvals: DataFrame) -> int:
    """approvals (verification_id): their pending proofs go to the accepted ones, where the first of a merchant's image stays. Unknown ones move nothing."""
    wanted = approvals.select("verification_id").distinct()

    def step(version: int) -> dict:
        pending, accepted = store.read("pending", PROOF, version), store.read("accepted", PROOF, version)
        moved = _one_each(pending.join(wanted, "verification_id", "left_semi"), "merchant_id", "sha256")
        known = accepted.select(F.col("merchant_id").alias("m"), F.col("sha256").alias("s"))
        new = moved.join(known, F.col("merchant_id").eqNullSafe(F.col("m")) & (F.col("sha256") == F.col("s")), "left_anti")
        return {"append": {"accepted": new}, "replace": {"pending": pending.join(wanted, "verification_id", "left_anti")}}

    return store.update(step)


def reset_proofs(store: Snapshots) -> int:
    """Forgets accepted and pending proofs; allocations stay."""
    return store.update(lambda version: {"replace": {"accepted": None, "pending": None}})
