"""Scans, file sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.amounts import parse_amount_minor
from ..functions.text import normalize_reference
from ..functions.times import parse_timestamp

# Fixed values.
SOURCES = {"PROVIDER": "PROVIDER_API", "WEBHOOK": "PROVIDER_API", "CSV": "MERCHANT_CSV", "MANUAL": "MANUAL_ENTRY", "DEMO": "SIMULATOR"}
EDITORS = ["photoshop", "gimp", "canva", "snapseed", "lightroom", "pixlr", "picsart", "paint.net", "affinity"]
PORTRAIT_RATIOS = [0.5625, 0.4615, 0.4500, 0.4286, 0.5000]
IMAGE_TYPES = {"jpeg": "^ffd8ff", "png": "^89504e470d0a1a0a", "webp": "^52494646.{8}57454250"}

RAW_CLAIM = T.StructType([T.StructField(c, T.StringType()) for c in ("claim_id", "provider", "amount", "sender_name", "receiver_name", "sender_account", "receiver_account", "reference_id", "timestamp", "full_text", "error_kind")])


def scoped(df: DataFrame, merchant: str) -> DataFrame:
    """Every query of one merchant starts here; tables are partitioned by merchant_id where they are large."""
    return df.where(F.col("merchant_id") == merchant)


def ledger_settled(ledger: DataFrame) -> DataFrame:
    return ledger.where("status = 'POSTED'")


def ledger_not_reversed(ledger: DataFrame) -> DataFrame:
    return ledger.where("status <> 'REVERSED'")


def active_allocations(allocations: DataFrame) -> DataFrame:
    return allocations.where("status = 'ACTIVE'")


def tenant_ok(claim_merchant: Column, txn_merchant: Column) -> Column:
    """A null on either side permits; else both must be equal."""
    return claim_merchant.isNull() | txn_merchant.isNull() | (claim_merchant == txn_merchant)


def read_value(rendered: Column) -> Column:
    """A dash is no value."""
    return F.nullif(rendered, F.lit("—"))


def engine_source(col: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv]), col)


def point_lookup(df: DataFrame, **keys) -> DataFrame:
    """At most two rows: one too many shows that the key is not unique."""
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    return df.limit(2)


def read_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The cases of a JSON manifest, one row each."""
    return spark.read.schema(T.StructType([T.StructField("cases", T.ArrayType(schema))])).json(path, multiLine=True).select(F.explode("cases").alias("c")).select("c.*")


def read_images(spark: SparkSession, path: str, max_bytes: int = 10_000_000) -> DataFrame:
    """path, sha256, bytes, kind, reject_reason of each file; refused files are rows too. Spark lists no empty files."""
    head = F.lower(F.hex(F.substring("content", 1, 12)))
    kind = F.lit(None).cast("string")
    for name, magic in IMAGE_TYPES.items():
        kind = F.when(head.rlike(magic), name).otherwise(kind)
    rows = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), kind.alias("kind"))
    return rows.withColumn("reject_reason", F.when(F.col("bytes") > max_bytes, "TOO_LARGE").when(F.col("kind").isNull(), "UNSUPPORTED_TYPE"))


def plausible_ratio(width: Column, height: Column) -> Column:
    ratio = F.least(width / height, height / width)
    return F.exists(F.array(*[F.lit(x) for x in PORTRAIT_RATIOS]), lambda r: F.abs(ratio - r) <= 0.03)


def editor_signature(metadata: Column) -> Column:
    """True where a key or value of the metadata names an editor."""
    return F.exists(F.concat(F.map_keys(metadata), F.map_values(metadata)), lambda v: F.lower(v).rlike("|".join(x.replace(".", r"\.") for x in EDITORS)))


def confidence_band(value: Column, refuted: Column) -> Column:
    return F.when(value.isNull(), "none").when(F.coalesce(refuted, F.lit(False)), "low").otherwise("high")


def extract_claims(raw: DataFrame) -> DataFrame:
    """Raw printed fields (RAW_CLAIM) to claims: parsed values, bands as confidences, notes. Refused or failed rows stay, empty."""
    ok = F.coalesce(F.col("error_kind"), F.lit("")) == ""
    at = parse_timestamp(F.when(ok, F.col("timestamp")))
    amount = parse_amount_minor(F.when(ok, F.col("amount")))
    notes = F.array_compact(F.array(F.when(~ok & (F.col("error_kind") != "REFUSED"), F.concat(F.lit("degraded:"), F.lower("error_kind"))), F.when(F.col("error_kind") == "REFUSED", F.lit("refused"))))

    def band(raw_col: str, parsed: Column) -> Column:
        b = confidence_band(F.when(ok, F.col(raw_col)), F.col(raw_col).isNotNull() & parsed.isNull())
        return F.when(b == "high", 1.0).when(b == "low", 0.5)

    entries = F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in {"amount": band("amount", amount), "timestamp": band("timestamp", at["resolved_s"]), "reference_id": band("reference_id", F.col("reference_id")), "sender_name": band("sender_name", F.col("sender_name"))}.items()]),
        lambda e: e["value"].isNotNull(),
    )
    keep = lambda c: F.when(ok, F.col(c)).alias(c)
    return raw.select(
        "claim_id", keep("provider"), amount.alias("amount_minor"), F.lit("PKR").alias("currency"), keep("sender_name"), keep("receiver_name"), keep("reference_id"),
        at["resolved_s"].alias("occurred_s"), at["granularity_s"].alias("granularity_s"), at["tz_stated"].alias("tz_stated"), at["date_inferred"].alias("date_inferred"), notes.alias("notes"), F.map_from_entries(entries).alias("confidences"),
    )


def write_decisions(decided: DataFrame, path: str, batch_id: str) -> None:
    """Decisions and their evidence under one batch id. A batch that is written again replaces itself: no row comes twice."""
    d = decided.withColumn("batch_id", F.lit(batch_id))
    own = ["batch_id", "claim_id", "status", "risk", "confidence", "reasons", "matched_txn_id", "fired_rule_id", "violation", "policy_fingerprint"]
    parts = {"attempts": d.select(*own), "evidence": d.select("batch_id", "claim_id", F.explode("evidence").alias("e")).select("batch_id", "claim_id", "e.*")}
    for name, rows in parts.items():
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{path}/{name}")


def in_utc(local: Column, stated_zone: Column | None = None, zone: str = "Asia/Karachi") -> Column:
    """Epoch seconds of a local reading (timestamp without zone) in its stated zone, else in ``zone``; null: null."""
    return F.unix_timestamp(F.to_utc_timestamp(local, F.lit(zone) if stated_zone is None else F.coalesce(stated_zone, F.lit(zone))))


def field_valid(field: str, raw: Column) -> Column:
    """True or false where the field has a form that its parser can refuse; null: nothing there, or no form to check."""
    checks = {"amount": lambda c: parse_amount_minor(c).isNotNull(), "timestamp": lambda c: parse_timestamp(c)["resolved_s"].isNotNull(), "reference_id": lambda c: normalize_reference(c) != ""}
    return F.when(raw.isNotNull(), checks[field](raw)) if field in checks else F.lit(None).cast("boolean")


def persisted_claims(claims: DataFrame) -> DataFrame:
    """Claims as they are stored: the reading's granularity is not."""
    return claims.select("claim_id", "merchant_id", "order_id", "amount_minor", "currency", "sender_name", "receiver_name", "reference_id", "occurred_s", "proof_sha256")


def extract_with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Raw rows of the first reader; where it failed, but did not refuse, those of the second (both RAW_CLAIM, one row a claim)."""
    failed = F.coalesce(F.col("error_kind"), F.lit("")) != ""
    again = first.where(failed & (F.col("error_kind") != "REFUSED")).select(F.col("claim_id").alias("again"))
    instead = second.join(again, F.col("claim_id") == F.col("again"), "left_semi")
    kept = first.join(instead.select(F.col("claim_id").alias("got")), F.col("claim_id") == F.col("got"), "left_anti")
    return kept.unionByName(instead)
