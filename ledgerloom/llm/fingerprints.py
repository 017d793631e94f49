"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each five-word shingle is hashed once; the hash's high bits name a bin and each
bin keeps its least hash. Empty bins are filled by optimal densification: bin i
takes the value of the first non-empty bin in a random order of its own. The
low bits of the bins, packed, are the fingerprint; agreement by chance is taken
out of the likeness.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import SPACES, Tables, ascii_lower, let, table

BIN_BITS, LOW_BITS, SHINGLE = 8, 4, 5
BINS = 1 << BIN_BITS
#: Probes of the random order that are tried one by one before the rest of it is searched at once.
PROBES = 6
_SHIFT = 64 - BIN_BITS
#: Holds all longs and one number below them.
ID = "decimal(20,0)"


def words(text: Column) -> Column:
    """Words of the whole text, A-Z lower-cased; null and blank texts: an empty array."""
    plain = F.trim(F.regexp_replace(F.translate(ascii_lower(F.coalesce(text, F.lit(""))), SPACES[1:], " " * (len(SPACES) - 1)), " {2,}", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def shingle_hashes(words_col: Column) -> Column:
    """64-bit hashes of all five-word shingles, repeats included; of the whole sequence if it is shorter."""

    def many(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - SHINGLE)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))

    return let(
        F.transform(words_col, lambda w: F.xxhash64(w)),
        lambda h: F.when(F.size(h) >= SHINGLE, many(h)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")),
    )


def bin_minima(hashes: Column) -> Column:
    """Array of BINS least hashes, null where a bin is empty.

    A guard with the bin's largest value joins the hashes, so that in sorted
    order the first value of each bin is its least hash or the guard.
    """
    half = BINS // 2
    guards = F.array(*[F.lit(((b - half) << _SHIFT) + ((1 << _SHIFT) - 1)).cast("long") for b in range(BINS)])
    top = (1 << _SHIFT) - 1
    firsts = let(
        F.sort_array(F.concat(hashes, guards)),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(s, i - 1), _SHIFT))),
    )
    return F.transform(firsts, lambda x: F.when(x.bitwiseAND(top) != top, x))


def _probe_table() -> list[list[int]]:
    """Row t: for each bin the t-th bin of its random order. Built from a rule, the same everywhere."""
    rng = np.random.default_rng(20170814)
    order = np.stack([rng.permutation(BINS) for _ in range(BINS)], 1)
    return order[:PROBES].tolist()


def densify(minima: Column) -> Column:
    """minima without nulls: each empty bin copies the first non-empty one in its order; null if all are empty."""
    rows = [F.array(*[F.lit(x) for x in row]) for row in _probe_table()]

    def fill(m: Column) -> Column:
        filled = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(m, j).isNotNull())

        def whole(v: Column) -> Column:  # v: numbers of the non-empty bins
            def one(x: Column, i: Column) -> Column:
                rest = F.array_min(F.transform(v, lambda j: F.struct(F.xxhash64(i, j).alias("o"), j.alias("j"))))
                copied = F.coalesce(*[F.get(m, F.get(r, i)) for r in rows], F.get(m, rest["j"]))
                return F.coalesce(x, F.xxhash64(copied, i))  # hashed, lest a value's low bits agree in all its copies

            return F.transform(m, one)

        return F.when(F.exists(m, lambda x: x.isNotNull()), let(filled, whole))

    return let(minima, fill)


def pack_bits(bins: Column) -> Column:
    """Longs that hold LOW_BITS of each bin's value; of an empty text an empty array."""
    per = 64 // LOW_BITS

    def word(m: Column, w: Column) -> Column:
        parts = [F.shiftleft(F.get(m, w * per + k).bitwiseAND((1 << LOW_BITS) - 1), LOW_BITS * k) for k in range(per)]
        out = parts[0]
        for x in parts[1:]:
            out = out.bitwiseOR(x)
        return out

    longs = let(bins, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), lambda w: word(m, w)))
    return F.coalesce(F.when(bins.isNotNull(), longs), F.array().cast("array<bigint>"))


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a whole text as an array of longs; empty for texts without words."""
    return let(densify(bin_minima(shingle_hashes(words(text)))), lambda b: F.when(b.isNull(), F.array().cast("array<bigint>")).otherwise(pack_bits(b)))


def to_string(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1: the share of equal bins less what chance gives. Two empty ones: 1, one: 0."""
    ones = sum(1 << (LOW_BITS * k) for k in range(64 // LOW_BITS))
    ones -= (1 << 64) if ones >= 1 << 63 else 0

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        folded = z
        for k in range(1, LOW_BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(z, k))
        return F.bit_count(folded.bitwiseAND(F.lit(ones).cast("long")))

    apart = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-LOW_BITS
    est = F.greatest(F.lit(0.0), ((1 - apart / BINS) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(est)


def neighbours(ids: DataFrame, spark: SparkSession) -> DataFrame:
    """id, prev: the id before it, in descending order, in a ring; ids: one column id, distinct.

    Ids are dealt into ranges; each range has its own window, and only the
    ranges' ends meet.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = ids.repartitionByRange(parts, F.col("id").desc()).withColumn("pid", F.spark_partition_id()).checkpoint()
    ends = ranged.groupBy("pid").agg(F.min("id").alias("low")).orderBy("pid").collect()
    lows = [r["low"] for r in ends]
    before = {r["pid"]: lows[i - 1] for i, r in enumerate(ends)}  # the first range follows the last
    if not before:
        return ranged.select("id", F.col("id").alias("prev"))
    head = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("pid"))
    return ranged.select("id", F.coalesce(F.lag("id").over(W.partitionBy("pid").orderBy(F.col("id").desc())), head).alias("prev"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text: the last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document's in descending doc_id, after
    the last the first. A null text is empty; a null doc_id comes last. Rows
    that repeat a doc_id, or have none, are all returned; as a next document
    they count as one, with the least of their texts. One document is its own next. No rows: none.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    none = F.lit(Decimal(-(1 << 63) - 1)).cast(ID)
    # The id tells a null, as it is below all longs. Id and text alone: both sides of the join below then read one and the same shuffle of the texts.
    base = docs.select(F.coalesce(F.col("doc_id").cast("long").cast(ID), none).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    # Widths alone first: the ring of ids, and how much of each text its predecessor wants.
    widths = tables.write(base.groupBy("id").agg(F.max(F.length("text")).alias("most"), F.count("*").alias("rows")), "widths")
    repeats = bool(widths.where("rows > 1").take(1))
    ring = neighbours(widths.select("id"), spark)
    wanted = ring.join(widths.select(F.col("id").alias("pid"), F.floor(F.col("most") / 2).cast("int").alias("half")), F.col("prev") == F.col("pid")).drop("pid")
    wanted = tables.write(wanted.select(F.col("id").alias("wid"), "prev", "half"), "wanted")
    own = base.join(wanted, F.col("id") == F.col("wid")).drop("wid")
    heads = own.select(F.col("prev").alias("hid"), F.col("text").substr(F.lit(1), F.col("half")).alias("head"))
    if repeats:
        heads = own.groupBy("prev", "half").agg(F.min("text").alias("t")).select(F.col("prev").alias("hid"), F.col("t").substr(F.lit(1), F.col("half")).alias("head"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("head").substr(F.lit(1), half))
    both = own.drop("half").join(heads, F.col("id") == F.col("hid")).select("id", "prev", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    made = both.select(
        "id", "prev", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fp"), fingerprint(F.col("edited")).alias("efp"),
        F.when(F.lit(repeats), F.col("text")).alias("order"),
    )
    made = tables.write(made, "fingerprints")
    tables.keep(made)
    nexts = made.select(F.col("prev").alias("hid"), F.col("fp").alias("next_fp"))
    if repeats:
        nexts = made.groupBy("prev").agg(F.min(F.struct("order", "fp")).alias("x")).select(F.col("prev").alias("hid"), F.col("x.fp").alias("next_fp"))
    done = made.join(nexts, F.col("id") == F.col("hid"))
    return done.select(
        F.when(F.col("id") > none, F.col("id").cast("long")).alias("doc_id"), "n_chars", "edited_sha256",
        to_string(F.col("fp")).alias("fingerprint"), to_string(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
