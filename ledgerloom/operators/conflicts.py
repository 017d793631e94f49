"""Allocations and proofs: who came first, and what conflicts with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EARLIEST = -62_135_596_800  # 0001-01-01, for absent times


def earliest_allocations(allocations: DataFrame) -> DataFrame:
    """txn_id, order_id, verification_id, contested: the first of each transaction; contested if there are several."""
    key = F.struct(F.coalesce("allocated_s", F.lit(EARLIEST)).alias("t"), F.col("order_id").alias("order_id"), F.coalesce("verification_id", F.lit("")).alias("v"))
    got = allocations.groupBy("txn_id").agg(F.min(key).alias("x"), (F.count("*") > 1).alias("contested"))
    return got.select("txn_id", F.col("x.order_id").alias("order_id"), F.nullif(F.col("x.v"), F.lit("")).alias("verification_id"), "contested")


def earliest_proofs(proofs: DataFrame) -> DataFrame:
    """sha256, order_id, order_ref, contested: the first of each image."""
    key = F.struct(
        F.coalesce("submitted_s", F.lit(EARLIEST)).alias("t"), F.coalesce("order_id", F.lit("")).alias("o"), F.coalesce("verification_id", F.lit("")).alias("v"), F.coalesce("order_ref", F.lit("")).alias("r")
    )
    got = proofs.where("sha256 is not null").groupBy("sha256").agg(F.min(key).alias("x"), (F.count("*") > 1).alias("contested"))
    return got.select("sha256", F.nullif(F.col("x.o"), F.lit("")).alias("order_id"), F.nullif(F.col("x.r"), F.lit("")).alias("order_ref"), "contested")


def allocation_conflicts(candidates: DataFrame, allocations: DataFrame) -> DataFrame:
    """candidates (claim_id, txn_id, order_id) with allocated_to and conflict.

    The same order is no conflict; without an order any allocation is.
    """
    first = earliest_allocations(allocations).select(F.col("txn_id").alias("at"), F.col("order_id").alias("allocated_to"), "contested")
    joined = candidates.join(first, F.col("txn_id") == F.col("at"), "left").drop("at")
    conflict = F.col("allocated_to").isNotNull() & (F.col("order_id").isNull() | (F.col("order_id") != F.col("allocated_to")))
    return joined.withColumn("conflict", conflict).withColumn("contested", F.coalesce("contested", F.lit(False)))


def proof_conflicts(claims: DataFrame, proofs: DataFrame) -> DataFrame:
    """claims (claim_id, proof_sha256, order_id) with reused and reused_name (reference before id; null if neither)."""
    first = earliest_proofs(proofs).select(F.col("sha256").alias("ps"), F.col("order_id").alias("po"), F.col("order_ref").alias("pr"), F.lit(True).alias("there"))
    joined = claims.join(first, F.col("proof_sha256") == F.col("ps"), "left")
    same = F.col("order_id").isNotNull() & F.col("po").isNotNull() & (F.col("order_id") == F.col("po"))
    reused = F.coalesce(F.col("there"), F.lit(False)) & ~same
    return joined.withColumn("reused", reused).withColumn("reused_name", F.when(reused, F.coalesce("pr", "po"))).drop("ps", "po", "pr", "there")


def uniqueness_violations(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")
