"""Comparison ladders: ordered levels, the first that holds wins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.amounts import power_of_ten_multiple
from ..functions.text import common_suffix_len
from ..functions.times import gauss, hour_offset, is_precise, window_gap_s
from ..policy import Policy

AGREE, WEAK, CONTRADICT, MISSING = "AGREE", "WEAK", "CONTRADICT", "MISSING"


@dataclass(frozen=True)
class Level:
    code: str
    label: str
    score: float
    agreement: str
    when: Column | None  # None: always


def check_ladder(levels: list[Level]) -> None:
    """Scores don't rise, codes are unique, only the last level always holds, MISSING codes and agreement go together."""
    if [x.score for x in levels] != sorted((x.score for x in levels), reverse=True):
        raise ValueError("scores rise")
    if len({x.code for x in levels}) != len(levels):
        raise ValueError("a code repeats")
    if [x.when is None for x in levels] != [False] * (len(levels) - 1) + [True]:
        raise ValueError("only the last level may always hold")
    if any(x.code.endswith("_MISSING") != (x.agreement == MISSING) for x in levels):
        raise ValueError("MISSING codes and agreement must go together")
    if not all(0.0 <= x.score <= 1.0 for x in levels):
        raise ValueError("scores lie in 0..1")


def ladder(field: str, levels: list[Level]) -> Column:
    """struct(field, code, label, score, agreement) of the first level that holds; a null predicate doesn't."""
    check_ladder(levels)

    def row(x: Level) -> Column:
        return F.struct(F.lit(field).alias("field"), F.lit(x.code).alias("code"), F.lit(x.label).alias("label"), F.lit(x.score).cast("double").alias("score"), F.lit(x.agreement).alias("agreement"))

    out = row(levels[-1])
    for x in reversed(levels[:-1]):
        out = F.when(x.when, row(x)).otherwise(out)
    return out


def reference_ladder(a: Column, b: Column, ca: Column, cb: Column, policy: Policy) -> Column:
    """a, b: normalised references; ca, cb: their confusable keys."""
    least = policy.ref_min_partial_len
    both = (F.length(a) > 0) & (F.length(b) > 0)
    short, long_ = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    enough = both & (F.length(short) >= least)
    return ladder("reference", [  # Fixed values: codes, labels, scores
        Level("REF_EXACT", "Exact match", 1.0, AGREE, both & (a == b)),
        Level("REF_CONFUSABLE", "Match after correcting look-alike characters", 0.90, AGREE, both & (ca == cb)),
        Level("REF_SUFFIX", "Ends with the same characters", 0.75, AGREE, enough & F.endswith(long_, short)),
        Level("REF_PARTIAL", "Partial match", 0.55, WEAK, (enough & F.contains(long_, short)) | (both & (common_suffix_len(a, b) >= least))),
        Level("REF_MISSING", "Reference not readable", 0.0, MISSING, ~F.coalesce(both, F.lit(False))),
        Level("REF_ELSE", "No reference match", 0.0, CONTRADICT, None),
    ])


def amount_ladder(claim: Column, ledger: Column, same_currency: Column, policy: Policy) -> Column:
    both = claim.isNotNull() & ledger.isNotNull()
    ok = both & F.coalesce(same_currency, F.lit(False))
    t = policy.amount_tolerance_minor
    return ladder("amount", [  # Fixed values: codes, labels, scores
        Level("AMT_EXACT", "Amount matches the transaction exactly", 1.0, AGREE, ok & (claim == ledger)),
        Level("AMT_TOLERANCE", "Amount matches within the permitted tolerance", 0.90, AGREE, ok & (F.abs(claim - ledger) <= t)),
        Level("AMT_SCALED", "Amounts differ by a factor of ten", 0.35, CONTRADICT, ok & (power_of_ten_multiple(claim, ledger) | power_of_ten_multiple(ledger, claim))),
        Level("AMT_MISSING", "Amount not readable", 0.0, MISSING, ~both),
        Level("AMT_ELSE", "Amounts do not match", 0.0, CONTRADICT, None),
    ])


def timestamp_similarity(start_s: Column, granularity_s: Column, date_inferred: Column, txn_s: Column, policy: Policy) -> Column:
    precise = is_precise(granularity_s, date_inferred)
    offset = F.when(precise, policy.ts_offset_s).otherwise(policy.ts_offset_s_date_inferred)
    scale = F.when(precise, policy.ts_scale_s).otherwise(policy.ts_scale_s_date_inferred)
    return gauss(window_gap_s(start_s, granularity_s, txn_s), offset, scale)


def timestamp_ladder(start_s: Column, granularity_s: Column, date_inferred: Column, txn_s: Column, sim: Column, policy: Policy) -> Column:
    precise = is_precise(granularity_s, date_inferred)
    both = start_s.isNotNull() & txn_s.isNotNull()
    off = F.when(precise, hour_offset((start_s - txn_s).cast("double"), policy.hour_artifact_tol_s))
    return ladder("timestamp", [  # Fixed values: codes, labels, scores
        Level("TS_TIGHT", "Same time as the transaction", 1.0, AGREE, both & precise & (sim >= policy.ts_sim_tight_t)),
        Level("TS_CLOSE", "Within a few minutes of the transaction", 0.85, AGREE, both & precise & (sim >= policy.ts_sim_close_t)),
        Level("TS_DATE_ONLY", "Same day as the transaction", 0.60, WEAK, both & (sim >= policy.ts_sim_close_t)),
        Level("TS_LOOSE", "Near the time of the transaction", 0.50, WEAK, both & (sim >= policy.ts_sim_loose_t)),
        Level("TS_HOUR_ART", "Differs by a whole number of hours", 0.25, WEAK, both & off.isNotNull()),
        Level("TS_MISSING", "Time not readable", 0.0, MISSING, ~both),
        Level("TS_ELSE", "Times do not match", 0.0, CONTRADICT, None),
    ])


def name_ladder(field: str, claim_tokens: Column, truth_tokens: Column, m: Column, masks: Column, policy: Policy) -> Column:
    """m, masks: the structs of alignment() and mask_metrics()."""
    both = (F.size(claim_tokens) > 0) & (F.size(truth_tokens) > 0)
    telling = m["idf_score"] >= policy.name_common_idf_t
    return ladder(field, [  # Fixed values: codes, labels, scores
        Level("NAME_EXACT", "Exact match", 1.0, AGREE, both & (claim_tokens == truth_tokens) & telling),
        Level("NAME_STRONG", "Strong match (minor spelling difference)", 0.90, AGREE, ~masks["present"] & ~m["initials"] & (m["token_score"] >= policy.name_strong_t) & telling),
        Level("NAME_MASK_OK", "Consistent with masked name", 0.85, AGREE, masks["ok"]),
        Level("NAME_INITIALS", "Match with initials expanded", 0.80, AGREE, m["initials"] & (m["token_score"] >= policy.name_initials_t)),
        Level("NAME_PARTIAL", "Partial match (shared name component)", 0.55, WEAK, (m["pairs"] >= 1) & telling),
        Level("NAME_COMMON_ONLY", "Only a very common name matched", 0.20, WEAK, (m["pairs"] >= 1) & ~telling),
        Level("NAME_MISSING", "Sender name not readable", 0.0, MISSING, ~both),
        Level("NAME_ELSE", "No name match", 0.0, CONTRADICT, None),
    ])


def aggregate_score(outcomes: list[tuple[Column, float]], policy: Policy) -> Column:
    """Weighted mean, 6 places: missing fields leave the numerator and keep penalty * weight in the denominator."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for outcome, weight in outcomes:
        missing = outcome["agreement"] == MISSING
        top = top + F.when(missing, 0.0).otherwise(outcome["score"] * weight)
        bottom = bottom + F.when(missing, policy.missing_evidence_penalty * weight).otherwise(weight)
    return F.when(bottom > 0, F.round(top / bottom, 6)).otherwise(0.0)
