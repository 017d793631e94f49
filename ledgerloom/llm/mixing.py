"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Document rates r(d) >= 0 minimise the relative entropy sum(r log(r / q) - r + q)
to the documents' prior rates q(d), subject to sum(size r) = target for each
source and to r <= cap. The solution tilts each document by its own size,
r(d) = min(cap, q(d) exp(lambda(s) size(d))), and the multipliers minimise the
convex dual. Newton iterations on the dual run as aggregations over all
documents, those alike in source, size and prior counted together; multipliers
stay in a table, so nothing that is sent to the driver grows with sources or
documents. Rates are then rounded into whole copies by error diffusion within
small buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import WORD, Tables, fresh, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
#: Documents that one error-diffusion bucket holds on average.
BUCKET_DOCS = 512
MAX_STEPS = 100
#: Up to so many sources, a row for each is broadcast; beyond, documents are salted into so many parts of each source.
BROADCAST_SOURCES, SALTS = 100_000, 64


def count_words(col) -> F.Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def _join_sources(rows: DataFrame, per: DataFrame, count: int, salt: Column) -> DataFrame:
    """rows with per's columns (count rows) of their source (column of); a source with very many rows never lands in one task."""
    same = F.col("source").eqNullSafe(F.col("of"))
    if count <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(per), same).drop("of")
    dealt = per.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, same & (F.col("salt") == F.col("of_salt"))).drop("of", "salt", "of_salt")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, rank, n, source_size, target from rows of (source, size, n): n documents of that size.

    Sources in code-point order, null last, take the weights in turn. Targets
    share ``share`` times all sizes by weight, stop at ``cap`` times the
    source's size, and what is over is shared anew by weight until none is above.
    """
    spark = sizes.sparkSession
    tables = Tables(spark)
    per = sizes.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # Ranks without one task for all sources: ranges, then each range's own rows, then offsets.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = per.repartitionByRange(parts, F.col("source").asc_nulls_last())
    ranged = tables.write(ranged.withColumn("pid", F.spark_partition_id()), "sources")
    counts = {r["pid"]: r["c"] for r in ranged.groupBy("pid").agg(F.count("*").alias("c")).collect()}
    first, at = {}, 0
    for pid in sorted(counts):
        first[pid], at = at, at + counts[pid]
    if not first:
        return ranged.select("source", F.lit(0).alias("rank"), "n", "source_size", F.lit(0.0).alias("target")).limit(0)
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col("pid"))
    inside = W.partitionBy("pid").orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranged.withColumn("rank", offset + F.row_number().over(inside) - 1).withColumn("weight", weight).drop("pid")
    ranked = tables.write(ranked, "ranked")
    # Targets are least(cap * size, weight * level); each round fixes the sources that are above.
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * cap
    level, fixed = 0.0, -1
    while True:
        above = limit <= F.col("weight") * level
        now = ranked.agg(
            F.sum(F.when(above, 1).otherwise(0)).alias("fixed"),
            F.sum(F.when(above, limit).otherwise(0.0)).alias("held"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if now["fixed"] == fixed or not now["open"]:
            break
        fixed, level = now["fixed"], (share * total - now["held"]) / now["open"]
    tables.keep(ranked)
    return ranked.withColumn("target", F.least(limit, F.col("weight") * level))


def solve_rates(classes: DataFrame, targets: DataFrame, cap: float = CAP, tolerance: float = 1e-9) -> DataFrame:
    """of (the source), lam, n, source_size, target: Newton iterations on the dual.

    classes: source, q, size, n (documents alike); targets: source, source_size,
    n, target. A document's rate is min(cap, q exp(lam size)). A source's
    gradient is sum(n size rate) - target, its Hessian the sum of n size^2 rate
    below the cap. Multipliers are moved in units of one over the source's mean
    size. A step that leaves the bracket of signs seen so far, or max(3, |lam|)
    on either side, goes to the middle instead. Targets that no multiplier
    reaches (above the cap, or of a source without a word) end at the bracket.
    """
    tables = Tables(classes.sparkSession)
    classes = tables.write(classes.select("source", "q", F.col("size").cast("double").alias("size"), F.col("n").alias("k")).where("size > 0 and q > 0"), "classes")
    # Where the target takes everything, the multiplier is that which lifts the last document to the cap.
    full = classes.groupBy(F.col("source").alias("s")).agg(F.max(F.log(F.lit(cap) / F.col("q")) / F.col("size")).alias("last"))
    unit = F.col("n") / F.greatest(F.col("source_size"), F.lit(1))
    whole = F.col("target") >= cap * F.col("source_size")
    start = targets.join(full, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("of"), "n", "source_size", "target", unit.alias("unit"), F.when(whole, F.coalesce(F.col("last") * (1 + 1e-12) / unit, F.lit(0.0))).otherwise(0.0).alias("z"),
        F.lit(-1e7).alias("lo"), F.lit(1e7).alias("hi"), (whole | (F.col("target") <= 0)).alias("done"),
    )
    state = tables.write(start, "multipliers")
    for _ in range(MAX_STEPS):
        left = state.where("not done").count()
        if not left:
            break
        both = _join_sources(classes, state.where("not done").select("of", "z", "unit"), left, F.col("size"))
        rate = F.col("q") * F.exp(F.least(F.lit(700.0), F.col("z") * F.col("unit") * F.col("size")))
        mass = F.col("k") * F.col("size")
        sums = both.groupBy(F.col("source").alias("s")).agg(
            F.sum(mass * F.least(F.lit(cap), rate)).alias("taken"), F.sum(F.when(rate < cap, mass * rate * F.col("size") * F.col("unit")).otherwise(0.0)).alias("h")
        )
        z, g = F.col("z"), F.coalesce("taken", F.lit(0.0)) - F.col("target")
        met = state.join(sums, F.col("of").eqNullSafe(F.col("s")), "left").drop("s").withColumn("g", g)
        met = met.withColumns({"lo": F.when(F.col("g") < 0, z).otherwise(F.col("lo")), "hi": F.when(F.col("g") > 0, z).otherwise(F.col("hi"))})
        reach = F.greatest(F.lit(3.0), F.abs(z))
        low, high = F.greatest("lo", z - reach), F.least("hi", z + reach)
        newton = z - F.col("g") / F.nullif(F.col("h"), F.lit(0.0))
        moved = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        done = F.col("done") | (F.abs("g") <= tolerance * F.col("target")) | (F.abs(moved - z) <= 1e-13 * F.abs(z))
        after = tables.write(met.select("of", "n", "source_size", "target", "unit", F.when(done, z).otherwise(moved).alias("z"), "lo", "hi", done.alias("done")), "multipliers")
        tables.drop(state)
        state = after
    tables.keep(state)
    return state.select("of", (F.col("z") * F.col("unit")).alias("lam"), "n", "source_size", "target")


def tilted(lam: Column, size: Column, cap: float = CAP, q: Column | None = None) -> Column:
    """The rate of a document: min(cap, q exp(lam size)); without words 1 (or q), as no constraint sees it."""
    tilt = F.exp(F.least(F.lit(700.0), lam * size))
    return F.least(F.lit(cap), tilt if q is None else q * tilt)


def copies(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """Copies of each distinct document. rows: id, size, source, mark; those alike in all four are n of one kind.

    Returns id, size, source, mark, n, source_size, target, rate, total: the n
    rows take ``total`` copies together, none above ``cap``. Every source's kinds
    are dealt by hash into buckets of about ``bucket_docs``; from the largest
    size down, each kind's copies are rounded so that what the bucket has taken
    stays as near to its rates as can be. A bucket is bounded whatever one
    source holds. Nulls in id and source are values like others; no rows: none.
    """
    tables = Tables(rows.sparkSession)
    kinds = tables.write(rows.groupBy("id", "size", "source", "mark").agg(F.count("*").alias("n")), "kinds")
    classes = tables.write(kinds.groupBy("source", "size").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")), "sizes")
    targets = tables.write(source_targets(classes, weights, share, cap), "targets")
    lam = solve_rates(classes.withColumn("q", F.lit(1.0)), targets, cap)
    known = lam.withColumn("buckets", F.ceil(F.col("n") / bucket_docs)).drop("n")
    dealt = _join_sources(kinds, known, targets.count(), F.col("id")).withColumn("rate", tilted(F.col("lam"), F.col("size"), cap))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("id", "mark", "size"), F.col("buckets")))
    item = F.struct((-F.col("size")).alias("o"), "id", "mark", "n", "rate")
    grouped = dealt.groupBy("source", "source_size", "target", "bucket").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def diffuse(s, x):
        size, n, rate = -x["o"], x["n"], x["rate"]
        want = rate * n + F.when(size > 0, s["e"] / size).otherwise(0.0)
        got = F.least(F.greatest(F.round(want), F.lit(0.0)), F.lit(math.floor(cap)) * n).cast("long")
        return F.named_struct(F.lit("e"), s["e"] + (rate * n - got) * size, F.lit("c"), F.concat(s["c"], F.array(got)))

    start = F.named_struct(F.lit("e"), F.lit(0.0), F.lit("c"), F.array().cast("array<bigint>"))
    done = grouped.withColumn("c", F.aggregate("items", start, diffuse, lambda s: s["c"]))
    flat = done.select("source", "source_size", "target", F.explode(F.arrays_zip("items", "c")).alias("z"))
    return flat.select(
        F.col("z.items.id").alias("id"), (-F.col("z.items.o")).alias("size"), "source", F.col("z.items.mark").alias("mark"),
        F.col("z.items.n").alias("n"), "source_size", "target", F.col("z.items.rate").alias("rate"), F.col("z.c").alias("total"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """Documents in their copies: the columns of docs, a row repeated as often as the mix takes it.

    Documents that take no copy are left out. Nulls in any column are allowed:
    a null text has no words, null sources are one source; texts are read whole.
    Rows alike in all of doc_id, source and text share their copies, and of their
    other columns those of one row are taken. Columns may have any other names.
    Empty input: no rows.
    """
    size, mark, i, s, o, m, n, t, c = fresh(docs, "size", "mark", "i", "s", "o", "m", "n", "t", "c")
    keyed = docs.withColumns({size: count_words(F.col("text")), mark: F.xxhash64("text")})
    taken = copies(keyed.select(F.col("doc_id").alias("id"), F.col(size).alias("size"), "source", F.col(mark).alias("mark")), **options)
    taken = taken.where("total > 0").select(F.col("id").alias(i), F.col("size").alias(s), F.col("source").alias(o), F.col("mark").alias(m), F.col("n").alias(n), F.col("total").alias(t))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(size) == F.col(s)) & (F.col(mark) == F.col(m)) & F.col("source").eqNullSafe(F.col(o))
    both = keyed.join(taken, same)
    once = both.where(F.col(n) == 1)
    again = both.where(F.col(n) > 1).dropDuplicates(["doc_id", "source", size, mark])
    return once.unionByName(again).withColumn(c, F.explode(F.sequence(F.lit(1), F.col(t).cast("int")))).select(*[F.col(f"`{x}`") for x in docs.columns])


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), count_words(F.col("text")).alias("size"), "source", F.lit(0).alias("mark"))
    c = copies(rows)
    # The n rows of a kind share its copies: the first (total mod n) take one more.
    c = c.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    each = F.floor(F.col("total") / F.col("n")) + F.when(F.col("i") < F.col("total") % F.col("n"), 1).otherwise(0)
    return c.select(F.col("id").alias("doc_id"), "size", F.col("source_size"), "target", (each * F.col("size")).cast("long").alias("taken"), "source", "rate", each.cast("int").alias("copies"))
