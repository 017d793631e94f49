"""Counts and reports over decisions and extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

STATUSES = ["SUSPICIOUS", "DUPLICATE", "NEEDS_REVIEW", "UNMATCHED", "VERIFIED"]  # in order of severity


def status_counts(d: DataFrame) -> DataFrame:
    """One row: a count for each status, zero where there is none, and what was verified."""
    return d.agg(
        F.count("*").alias("total_checked"), *[F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s.lower()) for s in STATUSES],
        F.coalesce(F.sum(F.when(F.col("status") == "VERIFIED", F.col("amount_minor"))), F.lit(0)).alias("verified_amount_minor"),
    )


def dashboard(d: DataFrame) -> DataFrame:
    c = status_counts(d)
    return c.select("total_checked", F.map_from_arrays(F.array(*[F.lit(s) for s in STATUSES]), F.array(*[s.lower() for s in STATUSES])).alias("by_status"), "verified_amount_minor")


def nav_tally(d: DataFrame) -> DataFrame:
    """verified, blocked (suspicious, duplicate), review (needs review, unmatched), by merchant."""
    n = lambda *s: F.sum(F.when(F.col("status").isin(*s), 1).otherwise(0))
    return d.groupBy("merchant_id").agg(n("VERIFIED").alias("verified"), n("SUSPICIOUS", "DUPLICATE").alias("blocked"), n("NEEDS_REVIEW", "UNMATCHED").alias("review"))


def history(d: DataFrame, limit: int = 50) -> DataFrame:
    """Newest first."""
    if limit < 1:
        raise ValueError("limit must be positive")
    return d.orderBy(F.col("now_s").desc(), F.col("claim_id").desc()).limit(limit)


def by_severity(d: DataFrame) -> DataFrame:
    return d.withColumn("severity", F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))).orderBy("severity", F.col("now_s").desc(), "claim_id")


def extraction_accuracy(rows: DataFrame) -> DataFrame:
    """rows: field, truth, read. n, correct, missing, wrong, accuracy and dangerous (wrong / n) of each field."""
    right = F.col("read").eqNullSafe(F.col("truth"))
    g = rows.groupBy("field").agg(
        F.count("*").alias("n"), F.sum(right.cast("int")).alias("correct"), F.sum((F.col("read").isNull() & ~right).cast("int")).alias("missing"), F.sum((F.col("read").isNotNull() & ~right).cast("int")).alias("wrong")
    )
    return g.withColumn("accuracy", F.col("correct") / F.col("n")).withColumn("dangerous", F.col("wrong") / F.col("n"))


def pattern_clusters(d: DataFrame) -> DataFrame:
    """Decisions with the same evidence codes: pattern, count, first claim; most frequent first."""
    pattern = F.array_join(F.transform("evidence", lambda e: e["code"]), "|")
    return d.where(F.size("evidence") > 0).groupBy(pattern.alias("pattern")).agg(F.count("*").alias("claims"), F.min("claim_id").alias("first_claim"))


def agreement(d: DataFrame, labels: DataFrame) -> DataFrame:
    """labels: claim_id, expected_status, expected_reason. One row of tallies."""
    j = d.join(labels, "claim_id")
    same = F.col("status") == F.col("expected_status")
    return j.agg(F.count("*").alias("cases"), F.sum(same.cast("int")).alias("status_agrees"), F.sum((same & F.array_contains("reasons", F.col("expected_reason"))).cast("int")).alias("both_agree"))


def row_match_count(d: DataFrame) -> DataFrame:
    return d.select("claim_id", F.size(F.filter("evidence", lambda e: e["agreement"] == "AGREE")).alias("agreeing"), F.size("evidence").alias("rows"))


def flagged_first(evidence) -> F.Column:
    """CONTRADICT, WEAK, MISSING, AGREE; stable."""
    order = F.array(*[F.lit(x) for x in ("CONTRADICT", "WEAK", "MISSING", "AGREE")])
    keyed = F.transform(evidence, lambda e, i: F.struct(F.array_position(order, e["agreement"]).alias("o"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda r: r["e"])


def plateau(sweep: DataFrame) -> DataFrame:
    """sweep: value, failures. first, last, width of the widest run of values at the least failures; of equal ones the last."""
    low = sweep.agg(F.min("failures").alias("low"))
    order = W.orderBy("value")  # a sweep has tens of values
    marked = sweep.crossJoin(F.broadcast(low)).withColumn("at", F.row_number().over(order))
    runs = marked.where("failures = low").withColumn("island", F.col("at") - F.row_number().over(order)).groupBy("island").agg(F.min("value").alias("first"), F.max("value").alias("last"), F.count("*").alias("width"))
    return runs.orderBy(F.col("width").desc(), F.col("first").desc()).limit(1).select("first", "last", "width")


def nearest_flips(sweep: DataFrame, default: float) -> DataFrame:
    """sweep: value, moved. The nearest value on either side of the default at which something moved."""
    return sweep.agg(F.max(F.when((F.col("value") < default) & F.col("moved"), F.col("value"))).alias("below"), F.min(F.when((F.col("value") > default) & F.col("moved"), F.col("value"))).alias("above"))


def category_counts(items: DataFrame, by: list[str], flag: F.Column, id_col: str) -> DataFrame:
    """items, flagged and the first id of each combination of ``by``; nulls are a category of their own."""
    return items.groupBy(*by).agg(F.count("*").alias("items"), F.count_if(flag).alias("flagged"), F.min(id_col).alias("first_id"))
