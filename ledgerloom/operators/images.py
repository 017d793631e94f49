"""Near images: difference hashes, and all pairs of hashes within a number of bits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that a hash may be sent under.
MOST_KEYS = 2_000


def difference_hash(values: Column) -> Column:
    """Hex of one bit a value, set where the next value (after the last: the first) is greater; null or no values: null.

    values: grey values in rows, their number a multiple of four.
    """
    n = F.size(values)
    bit = lambda i: F.when(F.element_at(values, (i % n + 1).cast("int")) > F.element_at(values, i.cast("int")), "1").otherwise("0")
    bits = F.array_join(F.transform(F.sequence(F.lit(1), n), bit), "")
    digits = F.transform(F.sequence(F.lit(1), n, F.lit(4)), lambda i: F.lower(F.conv(F.substring(bits, i, F.lit(4)), 2, 16)))
    return F.when(n > 0, F.array_join(digits, ""))


def _words(digest: Column, bits: int) -> Column:
    """The hash as 64-bit numbers."""
    return F.array(*[F.conv(F.substring(digest, i + 1, 16), 16, -10).cast("long") for i in range(0, bits // 4, 16)])


def _bits(digest: Column) -> Column:
    return F.array_join(F.transform(F.split(digest, ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")


def image_classes(images: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """id, class_id: the least id with the same hash. Rows without a hash have no class."""
    own = images.where(F.col(hash_col).isNotNull())
    least = own.groupBy(F.lower(hash_col).alias("h")).agg(F.min(id_col).alias("class_id"))
    return own.select(F.col(id_col).alias("id"), F.lower(hash_col).alias("own")).join(least, F.col("own") == F.col("h")).select("id", "class_id")


def near_classes(images: DataFrame, id_col: str, hash_col: str, distance: int, bits: int = 64, share: int = 1) -> DataFrame:
    """class_a, class_b (a < b), distance: all pairs of different hashes at most ``distance`` bits apart, by their classes' ids.

    A hash is cut into distance + share bands; ``distance`` changed bits leave at
    least ``share`` of them as they are, so a pair meets under a choice of that
    many bands and is confirmed on all bits. It is taken at its first such choice,
    so no pair comes twice. A larger share makes keys longer and more: right for
    short hashes, or where many have a band in common. Copies meet as one class;
    image_classes() tells the members. Rows without a hash have no part; a hash of
    another length is an error.
    """
    bands = distance + share
    if bits % 64 or distance < 0 or share < 1 or bands > bits:
        raise ValueError("bits must be a multiple of 64, share at least 1, distance + share at most bits")
    chosen = list(combinations(range(bands), share))
    if len(chosen) > MOST_KEYS:
        raise ValueError(f"{len(chosen)} keys a hash; take a smaller share or distance")
    ends = [bits * i // bands for i in range(bands + 1)]
    digest = F.lower(hash_col)
    digest = F.when(digest.rlike(f"^[0-9a-f]{{{bits // 4}}}$"), digest).otherwise(F.raise_error(F.concat(F.lit(f"not a hash of {bits} bits: "), digest)))
    classes = images.where(F.col(hash_col).isNotNull()).groupBy(digest.alias("h")).agg(F.min(id_col).alias("class_id"))
    band = lambda b, i: F.substring(b, ends[i] + 1, ends[i + 1] - ends[i])
    each = classes.select("class_id", _words(F.col("h"), bits).alias("words"), _bits(F.col("h")).alias("b"))
    keys = F.array(*[F.concat(*[band("b", i) for i in pick]) for pick in chosen])
    sent = each.select("class_id", "words", "b", F.posexplode(keys).alias("slot", "key"))
    l, r = (sent.select(*[F.col(c).alias(f"{side}_{c}") for c in sent.columns]) for side in "lr")
    # Spark sizes a table before its keys are laid out, and would broadcast what is many times larger.
    met = l.join(r.hint("merge"), (F.col("l_slot") == F.col("r_slot")) & (F.col("l_key") == F.col("r_key")) & (F.col("l_class_id") < F.col("r_class_id")))
    apart = F.aggregate(F.zip_with("l_words", "r_words", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    near = met.withColumn("distance", apart).where(F.col("distance") <= distance)
    alike = F.array_compact(F.array(*[F.when(band("l_b", i) == band("r_b", i), i) for i in range(bands)]))
    slots = F.array(*[F.array(*[F.lit(i) for i in pick]) for pick in chosen])
    first = F.slice(alike, 1, share) == F.element_at(slots, F.col("l_slot") + 1)
    return near.where(first).select(F.col("l_class_id").alias("class_a"), F.col("r_class_id").alias("class_b"), "distance")
