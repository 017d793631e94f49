"""List views, coverage, cross-checks and small Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import join_list, mask_reference
from ..policy import DEFAULT
from .aggregates import STATUSES
from .conflicts import earliest_allocations
from .decide import Rule, rules


def list_view(items: DataFrame, limit: int, status: str | None = None, provider: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the newest ``limit`` of the filtered items, one row with their total)."""
    if not 1 <= limit <= 500:
        raise ValueError("limit lies in 1..500")
    if status is not None:
        items = items.where(F.col("status") == status)
    if provider is not None:
        items = items.where(F.col("provider") == provider)
    return items.orderBy(F.col("now_s").desc(), F.col("claim_id").desc()).limit(limit), items.agg(F.count("*").alias("total"))


def visible(items: DataFrame, assignments: DataFrame, user: str) -> DataFrame:
    """Items whose order is assigned to the user."""
    mine = assignments.where(F.col("user_id") == user).select(F.col("order_id").alias("ao")).distinct()
    return items.join(mine, F.col("order_id") == F.col("ao"), "left_semi")


def matched_view(decided: DataFrame) -> DataFrame:
    """The least that a viewer needs of the matched transaction: masked reference, amount, time."""
    return decided.where("matched_txn_id is not null").select("claim_id", mask_reference(F.col("t_reference")).alias("reference"), F.col("t_amount").alias("amount_minor"), F.col("t_at").alias("occurred_s"))


def claim_view(claims: DataFrame) -> DataFrame:
    """Claims as shown: proof_id falls back to claim_id, the currency to PKR."""
    proof = F.coalesce("proof_id", "claim_id") if "proof_id" in claims.columns else F.col("claim_id")
    return claims.select("claim_id", proof.alias("proof_id"), "amount_minor", F.coalesce("currency", F.lit("PKR")).alias("currency"), "sender_name", "reference_id")


def hydrate(attempts: DataFrame, orders: DataFrame, claims: DataFrame) -> DataFrame:
    """History rows with their order's label and claim in two joins; rows without order, decision or risk are left out."""
    a = attempts.where("order_id is not null and status is not null and risk is not null")
    o = orders.select(F.col("order_id").alias("oid"), F.coalesce("order_ref", "order_id").alias("order_label"))
    c = claims.select(F.col("claim_id").alias("cid"), "amount_minor", "sender_name")
    return a.join(o, F.col("order_id") == F.col("oid")).join(c, F.col("claim_id") == F.col("cid"), "left").drop("oid", "cid")


def ranking_duplicates(ranked: DataFrame, allocations: DataFrame) -> DataFrame:
    """ranked: claim_id, order_id, txn_id, rnk. Conflicts, free ids and contested ids in ranking order; best_conflict if the winner conflicts."""
    first = earliest_allocations(allocations).select(F.col("txn_id").alias("at"), F.col("order_id").alias("allocated_to"), "contested")
    j = ranked.join(first, F.col("txn_id") == F.col("at"), "left")
    bad = F.col("allocated_to").isNotNull() & (F.col("order_id").isNull() | (F.col("order_id") != F.col("allocated_to")))
    pick = lambda when: F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("rnk", "txn_id")))), lambda r: r["txn_id"])
    return j.groupBy("claim_id").agg(
        pick(bad).alias("conflicts"), pick(~bad).alias("free"), pick(F.coalesce("contested", F.lit(False))).alias("contested"),
        F.max(F.when(bad & (F.col("rnk") == 1), F.col("allocated_to"))).alias("best_conflict"),
    )


def reason_coverage(decided: DataFrame) -> DataFrame:
    """reason, rules that carry it, claims that got it; a reason of no rule has none."""
    spark = decided.sparkSession
    table = spark.createDataFrame([(x, r.id) for r in rules(DEFAULT) for x in r.reasons], "reason string, rule string")
    carried = table.groupBy("reason").agg(F.sort_array(F.collect_set("rule")).alias("rules"))
    seen = decided.select(F.explode("reasons").alias("r")).groupBy("r").agg(F.count("*").alias("claims"))
    both = carried.join(seen, F.col("reason") == F.col("r"), "full")
    return both.select(F.coalesce("reason", "r").alias("reason"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"), F.coalesce("claims", F.lit(0)).alias("claims"))


#: Reasons that a compared amount and a contradiction add to the rule's own. Fixed values.
ADDED_REASONS = [
    "FIELD_CONTRADICTS_MATCH", "AMOUNT_EXACT", "AMOUNT_UNDERPAID", "AMOUNT_OVERPAID", "AMOUNT_OVERPAID_MATERIAL", "MISSING_ORDER_AMOUNT",
    "CLAIM_CONSISTENT", "CLAIM_INFLATED", "CLAIM_DEFLATED",
]


def coverage(decided: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """level (rule, status, reason, total), rule, status, reason, claims, expected: one pass over the decisions.

    What the rule table can give and no claim got is a row of zero claims; what it
    cannot give is not expected. table: rules of one's own.
    """
    table = rules(DEFAULT) if table is None else table
    rows = decided.select(F.col("fired_rule_id").alias("rule"), "status", F.posexplode_outer("reasons").alias("pos", "reason"))
    level = F.when(F.grouping("rule") == 0, "rule").when(F.grouping("status") == 0, "status").when(F.grouping("reason") == 0, "reason").otherwise("total")
    once = F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0)
    got = rows.groupingSets([["rule", "status"], ["status"], ["reason"], []], "rule", "status", "reason").agg(level.alias("level"), F.when(F.grouping("reason") == 0, F.count("*")).otherwise(once).alias("n"))
    got = got.where("level <> 'reason' OR reason IS NOT NULL")
    cells = [("rule", r.id, r.status, None) for r in table] + [("status", None, s, None) for s in STATUSES]
    cells += [("reason", None, None, x) for x in sorted({x for r in table for x in r.reasons} | set(ADDED_REASONS))] + [("total", None, None, None)]
    names = ["level", "rule", "status", "reason"]
    want = decided.sparkSession.createDataFrame(cells, "level string, rule string, status string, reason string").select(*[F.col(c).alias(f"w_{c}") for c in names], F.lit(True).alias("expected"))
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"w_{c}"))
    both = got.join(want, same, "full")
    return both.select(*[F.coalesce(c, f"w_{c}").alias(c) for c in names], F.coalesce("n", F.lit(0)).alias("claims"), F.coalesce("expected", F.lit(False)).alias("expected"))


def unfired_rules(decided: DataFrame) -> DataFrame:
    spark = decided.sparkSession
    return spark.createDataFrame([(r.id,) for r in rules(DEFAULT)], "rule string").join(decided.select(F.col("fired_rule_id").alias("rule")).distinct(), "rule", "left_anti")


def cross_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two decision frames by status pair: how many claims, and the first."""
    other = b.select(F.col("claim_id").alias("c"), F.col("status").alias("other_status"))
    return a.join(other, F.col("claim_id") == F.col("c")).groupBy("status", "other_status").agg(F.count("*").alias("claims"), F.min("claim_id").alias("first_claim"))


def agreement_phrase(evidence) -> F.Column:
    """'reference, amount and timestamp agree', from the evidence that does."""
    agreeing = F.transform(F.filter(evidence, lambda e: e["agreement"] == "AGREE"), lambda e: F.replace(e["field"], F.lit("_"), F.lit(" ")))
    return F.when(F.size(agreeing) == 0, "nothing agrees").when(F.size(agreeing) == 1, F.concat(join_list(agreeing), F.lit(" agrees"))).otherwise(F.concat(join_list(agreeing), F.lit(" agree")))


def missing_keys(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """key, problem: MISSING, EXTRA or DUPLICATE."""
    m = wanted.select(key).distinct().join(there.select(key), key, "left_anti").select(key, F.lit("MISSING").alias("problem"))
    e = there.select(key).distinct().join(wanted.select(key), key, "left_anti").select(key, F.lit("EXTRA").alias("problem"))
    d = there.groupBy(key).count().where("count > 1").select(key, F.lit("DUPLICATE").alias("problem"))
    return m.unionByName(e).unionByName(d)


def first_by_order(fixtures: DataFrame) -> DataFrame:
    """The first fixture of each order."""
    return fixtures.withColumn("i", F.row_number().over(W.partitionBy("order_id").orderBy("claim_id"))).where("i = 1").drop("i")


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A small result as a Markdown table, rows in the frame's order."""
    rows = df.limit(limit).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in rows]) + "\n"
