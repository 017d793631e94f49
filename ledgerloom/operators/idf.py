"""Inverse document frequencies of name tokens, for each merchant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import COMMON_NAME_TOKENS, name_tokens


def name_documents(ledger: DataFrame) -> DataFrame:
    """merchant_id, tokens: a row for each non-empty sender or receiver name."""
    both = ledger.select("merchant_id", F.explode(F.array("sender_name", "receiver_name")).alias("name"))
    return both.where("name is not null and name <> ''").select("merchant_id", name_tokens(F.col("name")).alias("tokens"))


def idf(names: DataFrame, floor: float, scoring: bool) -> DataFrame:
    """merchant_id, token, df, idf from name_documents().

    min(1, max(floor, ln(n / (1 + df)) / ln n)); common tokens are at most the
    floor. Scoring: below two names a merchant has the common tokens alone.
    Blocking: names without tokens don't count, and ln n is 1 at n <= 1.
    """
    docs = names if scoring else names.where(F.size("tokens") > 0)
    n = docs.groupBy("merchant_id").agg(F.count("*").alias("n"))
    each = docs.select("merchant_id", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("merchant_id", "token").agg(F.count("*").alias("df"))
    joined = each.join(n.withColumnRenamed("merchant_id", "m"), F.col("merchant_id").eqNullSafe(F.col("m"))).drop("m")
    if scoring:
        joined = joined.where("n >= 2")
    ln_n = F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(F.log(F.col("n").cast("double")))
    raw = F.greatest(F.lit(floor), F.least(F.lit(1.0), F.log(F.col("n") / (1.0 + F.col("df"))) / ln_n))
    seen = joined.select("merchant_id", "token", "df", F.when(F.col("token").isin(*COMMON_NAME_TOKENS), F.least(raw, F.lit(floor)) if not scoring else F.lit(floor)).otherwise(raw).alias("idf"))
    seeds = n.select("merchant_id", F.explode(F.array(*[F.lit(t) for t in COMMON_NAME_TOKENS])).alias("token")).join(
        seen.select(F.col("merchant_id").alias("m"), F.col("token").alias("t")), F.col("merchant_id").eqNullSafe(F.col("m")) & (F.col("token") == F.col("t")), "left_anti"
    )
    return seen.unionByName(seeds.select("merchant_id", "token", F.lit(0).cast("long").alias("df"), F.lit(floor).alias("idf")))
