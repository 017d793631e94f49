"""URL filters by hashed host-suffix and path-prefix expressions.

Each URL expands into expressions (a suffix of its host, a prefix of its path).
An expression's SHA-256 digest is matched to the rules' in two steps: an equi-join
on the first four bytes, then the full digest. Among the rules that fit, the
longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import ascii_lower, fresh, table

#: The rules of op1_url_filter: verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Up to so many rules (36 bytes and their strings each), their table is broadcast.
BROADCAST_RULES = 100_000
#: Beyond, URL expressions of one hash prefix are dealt to so many tasks.
SALTS = 32
#: Up to so many shapes (labels in the host, characters in the path) only those are expanded.
MAX_SHAPES = 200


def url_host(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expression(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _expand(host: Column, path: Column, shapes: list[tuple[int, int]] | None, most: int) -> Column:
    """Array of digests of the expressions that a rule could have."""
    labels = F.split(host, r"\.")
    if shapes is None:  # all suffixes of the host with all path prefixes up to the longest rule path
        suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))
        lengths = F.sequence(F.lit(0), F.least(F.length(path), F.lit(most)))
        return F.flatten(F.transform(suffixes, lambda h: F.transform(lengths, lambda n: _expression(h, path.substr(F.lit(1), n)))))
    made = [
        F.when(
            (F.size(labels) >= k) & (F.length(path) >= n),
            _expression(F.substring_index(host, ".", -k), F.substring(path, 1, n)),
        )
        for k, n in shapes
    ]
    return F.array_compact(F.array(*made)) if made else F.array().cast("array<string>")


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """keep's columns with host, path, rule (host + path, or null) and verdict.

    rules: verdict, host, path; hosts are compared in lower case (A-Z), rows with
    nulls or an empty host never fit, repeated rows count once. A rule fits its
    host and all subdomains if the URL's path starts with the rule's. The rule
    with the longest host + path wins, then the longer host, then block. URLs
    that no rule fits, null URLs and those without '://' get ``default``.
    Raises ValueError if keep names a column host, path, rule or verdict.
    Rows that repeat come back as often as they came; one shuffle, of distinct
    (keep, url), combined before it, so no frequent URL or host makes a hot task.
    """
    if clash := {c.lower() for c in keep} & {"host", "path", "rule", "verdict"}:
        raise ValueError(f"kept columns {sorted(clash)} have the names of results")
    spark = urls.sparkSession
    r = (
        rules.select(F.col("verdict").alias("rv"), ascii_lower(F.col("host")).alias("rh"), F.col("path").alias("rp"))
        .where("rv is not null and rh <> '' and rp is not null")
        .groupBy("rh", "rp").agg(F.max("rv").alias("rv"))  # 'block' > 'allow'
    )
    shape = r.select(F.size(F.split("rh", r"\.")).alias("k"), F.length("rp").alias("n")).distinct()
    shapes = [tuple(x) for x in shape.orderBy("k", "n").limit(MAX_SHAPES + 1).collect()]
    total, most = r.agg(F.count("*"), F.coalesce(F.max(F.length("rp")), F.lit(0))).first()
    r = r.withColumn("rd", _expression(F.col("rh"), F.col("rp"))).withColumn("rx", _prefix(F.col("rd")))

    kept = urls.select(*keep)
    url, n_col, host, path, digest, x, salt, won_col, i, rh, rp, rv, rd, rx, rs = fresh(kept, *"url n host path digest x salt won i rh rp rv rd rx rs".split())
    r = r.withColumnsRenamed({"rh": rh, "rp": rp, "rv": rv, "rd": rd, "rx": rx})
    base = urls.select(*keep, F.col(url_col).alias(url))
    groups = base.groupBy(*base.columns).agg(F.count("*").alias(n_col))
    groups = groups.select(*keep, url, n_col, url_host(F.col(url)).alias(host), url_path(F.col(url)).alias(path))
    wide = groups.withColumn(digest, F.explode_outer(_expand(F.col(host), F.col(path), shapes if len(shapes) <= MAX_SHAPES else None, most)))
    wide = wide.withColumn(x, _prefix(F.col(digest)))
    if total <= BROADCAST_RULES:
        hits = wide.join(F.broadcast(r), F.col(x) == F.col(rx), "left")
    else:
        salted = r.withColumn(rs, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        wide = wide.withColumn(salt, F.pmod(F.xxhash64(*keep, url), F.lit(SALTS)).cast("int"))
        hits = wide.join(salted, (F.col(x) == F.col(rx)) & (F.col(salt) == F.col(rs)), "left")
    sure = F.col(rd) == F.col(digest)
    rank = F.when(sure, F.struct(F.length(F.concat(rh, rp)).alias("a"), F.length(rh).alias("b"), F.col(rv).alias("v"), F.concat(rh, rp).alias("rule")))
    won = hits.groupBy(*keep, url, n_col, host, path).agg(F.max(rank).alias(won_col))
    return won.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n_col).cast("int")))).select(
        *keep,
        F.col(host).alias("host"),
        F.col(path).alias("path"),
        F.col(f"{won_col}.rule").alias("rule"),
        F.coalesce(f"{won_col}.v", F.lit(default)).alias("verdict"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP1_SQL = r"""
WITH rules(rv, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
    ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path, row_number() OVER () AS i FROM pages),
m AS (SELECT i, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS v
    FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (i)
"""
