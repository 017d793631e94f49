"""Tables over the distinct names of each merchant: token weights and phonetic keys.

A name's tokens are weighed once for each merchant that has it, however often
it comes; Metaphone and NYSIIS run once for each distinct token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import name_tokens, rarest_two, token_similarity
from ..functions.phonetics import phonetic_codes


def weighed_names(rows: DataFrame, columns: list[str], table: DataFrame) -> DataFrame:
    """merchant_id, name, tokens, weights of the distinct names in the columns of rows; table: idf().

    Weights are in the tokens' order; tokens that the table lacks are null there.
    Null names are left out, names without tokens have empty arrays.
    """
    names = rows.select("merchant_id", F.explode(F.array(*columns)).alias("name")).where("name is not null").distinct()
    each = names.withColumn("tokens", name_tokens(F.col("name"))).select("merchant_id", "name", F.posexplode_outer("tokens").alias("pos", "token"))
    known = table.select(F.col("merchant_id").alias("m"), F.col("token").alias("t"), "idf")
    met = each.join(known, F.col("merchant_id").eqNullSafe(F.col("m")) & (F.col("token") == F.col("t")), "left")
    back = met.groupBy("merchant_id", "name").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "token", "idf")))).alias("x"))
    return back.select("merchant_id", "name", F.transform("x", lambda r: r["token"]).alias("tokens"), F.transform("x", lambda r: r["idf"]).alias("weights"))


def name_keys(rows: DataFrame, columns: list[str], table: DataFrame, floors: list[float] | None = None) -> DataFrame:
    """merchant_id, name, name_key: the distinct phonetic keys of the two rarest tokens of each distinct name in the columns.

    floors: keys for each of several least weights, with the number of the floor and a tilde before each key; table then has a floor of 0.
    """
    book = weighed_names(rows, columns, table)
    if floors:
        lifted = lambda f: F.transform("weights", lambda w: F.when(w.isNotNull(), F.greatest(w, f)))
        book = book.select("merchant_id", "name", "tokens", "weights", F.posexplode(F.array(*[F.lit(float(x)) for x in floors])).alias("at", "floor"))
        two = book.select(F.col("merchant_id"), "name", "at", F.explode(rarest_two(F.col("tokens"), lifted(F.col("floor")))).alias("token"))
        codes = two.select("token").distinct().select(F.col("token").alias("t"), F.explode(phonetic_codes(F.col("token"))).alias("code"))
        return two.join(codes, F.col("token") == F.col("t")).select("merchant_id", "name", F.concat_ws("~", "at", "code").alias("name_key")).distinct()
    two = book.select("merchant_id", "name", F.explode(rarest_two(F.col("tokens"), F.col("weights"))).alias("token"))
    codes = two.select("token").distinct().select(F.col("token").alias("t"), F.explode(phonetic_codes(F.col("token"))).alias("name_key"))
    return two.join(codes, F.col("token") == F.col("t")).select("merchant_id", "name", "name_key").distinct()


def keyed_rows(rows: DataFrame, key: str, columns: list[str], keys: DataFrame) -> DataFrame:
    """key, name_key: the distinct keys of each row's names; keys: name_keys()."""
    keys = keys.select(F.col("merchant_id").alias("m"), "name", "name_key")
    each = rows.select(key, "merchant_id", F.explode(F.array_distinct(F.array(*columns))).alias("n"))
    met = each.join(keys, F.col("merchant_id").eqNullSafe(F.col("m")) & (F.col("n") == F.col("name")))
    return met.select(key, "name_key").distinct()


def with_weights(rows: DataFrame, name: str, table: DataFrame, tokens: str, weights: str) -> DataFrame:
    """rows with the tokens of one name column and their weights; unknown tokens weigh 1, null names have none."""
    book = weighed_names(rows, [name], table).select(F.col("merchant_id").alias("wm"), F.col("name").alias("wn"), F.col("tokens").alias("wt"), F.col("weights").alias("ww"))
    met = rows.join(book, F.col("merchant_id").eqNullSafe(F.col("wm")) & (F.col(name) == F.col("wn")), "left")
    known = F.transform("ww", lambda w: F.coalesce(w, F.lit(1.0)))
    return met.withColumns({tokens: F.coalesce("wt", F.array().cast("array<string>")), weights: F.coalesce(known, F.array().cast("array<double>"))}).drop("wm", "wn", "wt", "ww")


def similar_tokens(pairs: DataFrame, claim_tokens: DataFrame, txn_tokens: DataFrame, pair_min: float) -> DataFrame:
    """claim_id, similar: array of struct(a, b, sim), for claims that have any.

    pairs: claim_id, txn_id; the others: claim_id or txn_id, tokens. a is a token
    of the claim, b another of one of its candidates, both of more than one
    letter, at least pair_min alike. Each distinct pair of tokens is compared once.
    """
    theirs = pairs.select("claim_id", "txn_id").join(txn_tokens.select(F.col("txn_id").alias("t"), "tokens"), F.col("txn_id") == F.col("t")).select("claim_id", F.explode("tokens").alias("b"))
    own = claim_tokens.select(F.col("claim_id").alias("c"), F.explode(F.array_distinct("tokens")).alias("a"))
    met = theirs.where("length(b) > 1").distinct().join(own.where("length(a) > 1"), F.col("claim_id") == F.col("c")).where("a <> b").select("claim_id", "a", "b")
    alike = met.select("a", "b").distinct().withColumn("sim", token_similarity(F.col("a"), F.col("b"), pair_min)).where(F.col("sim") >= pair_min)
    return met.join(alike, ["a", "b"]).groupBy("claim_id").agg(F.collect_list(F.struct("a", "b", "sim")).alias("similar"))
