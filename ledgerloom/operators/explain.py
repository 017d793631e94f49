"""Decisions in words. The sentences are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import format_money
from ..functions.text import join_list
from ..functions.times import format_instant

# Fixed values.
ABSENT = "—"
MARKS = {"AGREE": "✓", "WEAK": "⚠", "CONTRADICT": "✗", "MISSING": "?"}
LABELS = {"reference": "Transaction ID", "amount": "Amount", "timestamp": "Timestamp", "sender_name": "Sender name", "receiver_name": "Receiver name"}
HEADLINES = {
    "VERIFIED": "✅ PAYMENT VERIFIED", "UNMATCHED": "❓ PAYMENT NOT FOUND", "SUSPICIOUS": "⚠ PAYMENT DETAILS DO NOT MATCH",
    "DUPLICATE": "🔁 PAYMENT ALREADY USED", "NEEDS_REVIEW": "⚠ MANUAL REVIEW REQUIRED",
}
ACTIONS = {
    "VERIFIED": "Continue with the order. The payment is in your transaction feed.",
    "UNMATCHED": "Do not approve yet. The payment may still be processing — check again shortly, or look through your transaction feed.",
    "SUSPICIOUS": "Do not approve the order yet.",
    "DUPLICATE": "Do not approve the order. This payment was already used for another order — check that order before doing anything else.",
    "NEEDS_REVIEW": "Check this payment yourself before approving the order.",
}
REUSED_ACTION = "Do not approve the order. Ask the customer for a fresh receipt for this order — this one has been sent before."
OBSERVATIONS = {
    "IMAGE_EXIF_MISSING": "Image metadata is missing",
    "IMAGE_EDITOR_SIGNATURE": "Image was saved by photo-editing software",
    "IMAGE_ELA_ANOMALY": "Possible editing detected in part of the image",
    "IMAGE_RECOMPRESSED": "Image was re-saved after its original capture",
    "AMOUNT_OCR_GLYPH_FIXUP": "Some amount characters had to be corrected when reading",
    "AMOUNT_SEPARATOR_AMBIGUOUS": "The amount's decimal separator was ambiguous",
    "AMOUNT_NON_ASCII_DIGITS": "The amount was written in non-Latin digits",
    "CLAIM_INFLATED_ROUND": "The claimed amount is the received amount with a digit added",
    "TIME_MERIDIEM_AMBIGUOUS": "The receipt did not make AM or PM clear",
    "TIME_DATE_INFERRED": "The receipt showed no date, so today's date was assumed",
    "TIME_TZ_ASSUMED": "The receipt showed no time zone, so Pakistan time was assumed",
    "TIME_WHOLE_HOUR_OFFSET": "The times differ by a whole number of hours",
    "NAME_MASKED": "The sender name was partly hidden by the wallet",
    "NAME_COMMON_TOKENS_ONLY": "The names agree only on a very common name",
}
PARTIALLY_TRUSTED = "This transaction came from an imported or hand-entered record rather than your live bank feed, so a person needs to confirm it."
LOW_CONFIDENCE = "Part of this screenshot could not be read clearly, so a person should check it against the transaction."
REUSE_PREFIX = "PROOF_PREVIOUSLY_SUBMITTED:"
ORDER = ["reference", "amount", "timestamp", "sender_name"]


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def observation_line(code: Column) -> Column:
    ref = F.trim(code.substr(F.lit(len(REUSE_PREFIX) + 1), F.length(code)))
    reuse = F.when(ref != "", F.concat(F.lit("This same screenshot was submitted for order "), ref)).otherwise("This same screenshot was submitted before")
    return F.when(code.startswith(REUSE_PREFIX), reuse).otherwise(F.coalesce(lookup(OBSERVATIONS, code), code))


def summary() -> Column:
    has = lambda r: F.array_contains("reasons", r)
    named = F.col("matched_txn_id").isNotNull()
    amount_equal = F.exists("evidence", lambda e: e["code"] == "AMT_EXACT") & F.col("amount_minor").isNotNull()
    received = F.when(named, format_money(F.col("t_amount"))).when(amount_equal, format_money(F.col("amount_minor"))).otherwise(ABSENT)
    claimed, expected = format_money(F.col("amount_minor")), format_money(F.col("expected_minor"))
    known_r, known_e = received != ABSENT, expected != ABSENT

    def against(less: str, none: str) -> Column:
        return F.when(known_r & known_e, F.concat(received, F.lit(" was received against an order for "), expected, F.lit("."))).when(
            known_e, F.concat(F.lit(f"{less} than the order total of "), expected, F.lit(" was received."))
        ).otherwise(none)

    labels = F.transform(F.filter(F.array(*[F.lit(f) for f in ORDER]), lambda f: F.array_contains("contradicting", f)), lambda f: F.lower(lookup(LABELS, f)))
    contradiction = F.when(F.size(labels) == 0, "One of the details does not match the transaction this receipt points to.").when(
        F.size(labels) == 1, F.concat(F.lit("The "), join_list(labels), F.lit(" does not match the transaction this receipt otherwise points to."))
    ).otherwise(F.concat(F.lit("The "), join_list(labels), F.lit(" do not match the transaction this receipt otherwise points to.")))
    verified = F.concat_ws("\n",
        F.when(known_r, F.concat(received, F.lit(" received."))),
        F.when(named, F.concat(F.lit("Transaction "), "matched_txn_id", F.lit(" matches the submitted proof."))),
        F.when(has("AMOUNT_OVERPAID") & known_r & known_e, F.concat(F.lit("That is more than the order total of "), expected, F.lit("."))),
    )
    review = F.concat_ws("\n",
        F.when(has("FIELD_CONTRADICTS_MATCH"), contradiction),
        F.when(has("AMOUNT_OVERPAID_MATERIAL"), against("Much more", "Much more was received than this order asked for.")),
        F.when(has("AMOUNT_UNDERPAID"), against("Less", "Less was received than this order asked for.")),
        F.when(has("SOURCE_PARTIALLY_TRUSTED"), PARTIALLY_TRUSTED),
        F.when(has("LOW_EXTRACTION_CONFIDENCE"), LOW_CONFIDENCE),
    )
    earlier = F.get(F.filter(F.transform(F.filter("observations", lambda o: o.startswith(REUSE_PREFIX)), lambda o: F.trim(o.substr(F.lit(len(REUSE_PREFIX) + 1), F.length(o)))), lambda r: r != ""), F.lit(0))
    status = F.col("status")
    return (
        F.when(status == "VERIFIED", F.when(verified != "", verified).otherwise("This payment matches a transaction in your feed."))
        .when(status == "UNMATCHED", F.when(has("NO_CANDIDATES"), "No matching transaction was found in your feed.").otherwise("No transaction in your feed matched this proof closely enough."))
        .when(status == "SUSPICIOUS", F.when(has("CLAIM_INFLATED") & known_r & (claimed != ABSENT), F.concat(F.lit("The screenshot claims "), claimed, F.lit(", but "), received, F.lit(" was received."))).when(
            has("TAMPER_OBSERVATIONS"), "The image looks edited and the details match only weakly.").otherwise("A transaction was found, but the details conflict."))
        .when(status == "DUPLICATE", F.when(has("PROOF_REUSED"), F.when(earlier.isNotNull(), F.concat(F.lit("This same screenshot was already used for order "), earlier, F.lit("."))).otherwise(
            "This same screenshot was already used for an earlier order.")).otherwise("This transaction was already used for another order."))
        .otherwise(F.when(has("AMBIGUOUS_CANDIDATES"), "More than one transaction matches this screenshot equally well.").when(review != "", review).otherwise("There is not enough evidence to decide this automatically."))
    )


def explain(decided: DataFrame, *more: Column) -> DataFrame:
    """claim_id, status, risk, headline, summary, rows, observation_lines, action, text from decide(). more: further columns over it."""
    named = F.col("matched_txn_id").isNotNull()
    claimed = {"reference": F.coalesce(F.nullif(F.col("reference_id"), F.lit("")), F.lit(ABSENT)), "amount": format_money(F.col("amount_minor")), "timestamp": format_instant(F.col("occurred_s"), F.col("granularity_s")), "sender_name": F.coalesce(F.nullif(F.col("sender_name"), F.lit("")), F.lit(ABSENT))}
    actual = {"reference": F.col("t_reference"), "amount": format_money(F.col("t_amount")), "timestamp": format_instant(F.col("t_at")), "sender_name": F.col("t_sender")}

    def row(f: str) -> Column:
        o = F.get(F.filter("evidence", lambda e: e["field"] == f), F.lit(0))
        verdict = F.when(o["code"] == "NAME_COMMON_ONLY", "Name agrees, but only on a very common name").otherwise(o["label"])
        shown = F.when(named, F.coalesce(F.nullif(actual[f], F.lit("")), F.lit(ABSENT))).otherwise(ABSENT)
        return F.when(o.isNotNull(), F.struct(F.lit(f).alias("field"), F.lit(LABELS[f]).alias("label"), claimed[f].alias("claimed"), shown.alias("actual"), verdict.alias("verdict"), o["code"].alias("level_code"), lookup(MARKS, o["agreement"]).alias("mark")))

    d = decided.select(
        "claim_id", "status", "risk", "reasons", "matched_txn_id", "fired_rule_id", "confidence", lookup(HEADLINES, F.col("status")).alias("headline"), summary().alias("summary"),
        F.array_compact(F.array(*[row(f) for f in ORDER])).alias("rows"), F.transform("observations", observation_line).alias("observation_lines"),
        F.when((F.col("status") == "DUPLICATE") & F.array_contains("reasons", "PROOF_REUSED"), REUSED_ACTION).otherwise(lookup(ACTIONS, F.col("status"))).alias("action"), *more,
    )
    amount = F.get(F.filter("rows", lambda r: (r["field"] == "amount") & (r["actual"] != ABSENT)), F.lit(0))
    width = F.greatest(F.length(amount["claimed"]), F.length(amount["actual"]))
    pad = lambda v: F.concat(F.repeat(F.lit(" "), (width - F.length(v)).cast("int")), v)
    block = F.when(amount.isNotNull(), F.concat(F.lit("\nScreenshot: "), pad(amount["claimed"]), F.lit("\nReceived:   "), pad(amount["actual"])))
    lines = F.when(F.size("rows") > 0, F.concat(F.lit("\n"), F.array_join(F.transform("rows", lambda r: F.concat(r["mark"], F.lit(" "), r["label"], F.lit(": "), r["verdict"])), "\n")))
    seen = F.when(F.size("observation_lines") > 0, F.concat(F.lit("\n"), F.array_join(F.transform("observation_lines", lambda o: F.concat(F.lit("⚠ "), o)), "\n")))
    text = F.concat_ws("\n", F.col("headline"), F.lit(""), F.col("summary"), block, lines, seen, F.concat(F.lit("\nRisk: "), F.col("risk")), F.lit("\nRecommended action:"), F.col("action"))
    return d.withColumn("text", text)


def api_result(decided: DataFrame) -> DataFrame:
    """claim_id and the result as JSON; degraded if any note says so."""
    degraded = F.exists(F.coalesce("notes", F.array().cast("array<string>")), lambda n: n.startswith("degraded:")).alias("degraded")
    both = explain(decided, degraded)
    return both.select("claim_id", F.to_json(F.struct("claim_id", "status", "risk", "confidence", "reasons", "matched_txn_id", "fired_rule_id", "headline", "summary", "rows", "observation_lines", "action", "degraded")).alias("result"))
