"""Queries over the payment views and the SQL that says the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..functions import amounts, misc, names, text, times
from ..operators import aggregates, blocking, conflicts, explain, idf, images, reports, sweep, workflow
from ..operators.decide import DECISION_KNOBS, anchored, candidate_pairs, decide, rank, score_candidates
from ..policy import DEFAULT
from ..sources import blobs, snapshots, tables
from ..sources.testdata import duck_ctes, views
from ..storage import Tables, new_path
from . import named_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def settled(v: dict[str, DataFrame]) -> DataFrame:
    return tables.ledger_settled(v["ledger"])


REF = "regexp_replace(regexp_replace(upper(coalesce({0}, '')), '^(TRANSACTION\\s*ID|TID|TXN|TRX|REF)[:#\\s]*', ''), '[^A-Z0-9]', '', 'g')"
CONF = "translate({0}, 'OQDILSBZG', '000115826')"
TENANT = "(c.merchant_id IS NULL OR t.merchant_id IS NULL OR c.merchant_id = t.merchant_id)"
BOTH = (
    duck_ctes("ledger", "claims")
    + f""", t AS (SELECT *, {REF.format("coalesce(nullif(external_id, ''), txn_id)")} AS ref FROM ledger WHERE status = 'POSTED'),
c AS (SELECT *, {REF.format('reference_id')} AS ref, coalesce(occurred_s, now_s) AS anchor_s FROM claims)
"""
)


# ---- scans and predicates


@query(duck_ctes("ledger") + " SELECT txn_id, merchant_id, amount_minor, occurred_s FROM ledger WHERE status = 'POSTED'")
def scan_settled(spark, sf):
    return settled(views(spark, sf)).select("txn_id", "merchant_id", "amount_minor", "occurred_s")


@query(duck_ctes("ledger") + " SELECT txn_id, status, source FROM ledger WHERE status <> 'REVERSED' AND merchant_id = 'M3'")
def scan_ledger_of_merchant(spark, sf):
    return tables.scoped(tables.ledger_not_reversed(views(spark, sf)["ledger"]), "M3").select("txn_id", "status", "source")


@query(duck_ctes("allocations") + " SELECT txn_id, order_id, verification_id FROM allocations WHERE status = 'ACTIVE'")
def active_allocations(spark, sf):
    return tables.active_allocations(views(spark, sf)["allocations"]).select("txn_id", "order_id", "verification_id")


@query(
    duck_ctes("submissions")
    + """, a AS (SELECT merchant_id, doc_id, sha256, 'A' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS attempt_id FROM submissions WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0)
SELECT merchant_id, sha256, min(attempt_id) AS attempt_id FROM a GROUP BY ALL"""
)
def accepted_proofs(spark, sf):
    s = views(spark, sf)["submissions"]
    attempt = F.concat(F.lit("A"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    proofs = s.select("merchant_id", F.col("doc_id").alias("proof_id"), "sha256")
    attempts = s.select("merchant_id", F.col("doc_id").alias("proof_id"), attempt.alias("attempt_id"), "order_id", F.when(F.col("doc_id") % 3 != 0, "VERIFIED").otherwise("UNMATCHED").alias("decision"))
    allocs = s.select(attempt.alias("attempt_id"), F.when(F.col("doc_id") % 5 != 0, "ACTIVE").otherwise("RELEASED").alias("status"))
    orders = s.select("order_id", F.lit(None).cast("string").alias("order_ref"))
    return workflow.accepted_proofs(proofs, attempts, allocs, orders).select("merchant_id", "sha256", "attempt_id")


@query(BOTH + f"SELECT c.claim_id, t.txn_id FROM c JOIN t ON c.ref <> '' AND c.ref = t.ref AND {TENANT}")
def tenant_filter(spark, sf):
    v = views(spark, sf)
    c, t = blocking.with_keys(v["claims"], F.col("reference_id")), blocking.with_keys(settled(v), blocking.ledger_reference())
    t = t.select("txn_id", F.col("ref_norm").alias("tr"), F.col("merchant_id").alias("tm"))
    return c.join(t, (F.col("ref_norm") != "") & (F.col("ref_norm") == F.col("tr")) & tables.tenant_ok(F.col("merchant_id"), F.col("tm"))).select("claim_id", "txn_id")


@query(
    duck_ctes("ledger")
    + """ SELECT txn_id, CASE WHEN external_id IS NULL OR external_id = '' THEN NULL WHEN length(external_id) <= 4 THEN '••••' ELSE left(external_id, 2) || '••••' || right(external_id, 2) END AS masked FROM ledger"""
)
def masked_reference(spark, sf):
    return views(spark, sf)["ledger"].select("txn_id", text.mask_reference(F.col("external_id")).alias("masked"))


@query(duck_ctes("ledger") + " SELECT count(*) AS duplicates FROM (SELECT txn_id FROM ledger GROUP BY 1 HAVING count(*) > 1)")
def unique_transactions(spark, sf):
    return conflicts.uniqueness_violations(views(spark, sf)["ledger"], "txn_id").agg(F.count("*").alias("duplicates"))


# ---- blocking joins: each kind through the one join


def _hits(spark, sf, kind: str) -> DataFrame:
    v = views(spark, sf)
    c, t = anchored(v["claims"]), settled(v)
    number = blocking.KINDS.index(kind)
    if number == blocking.TIME:
        return blocking.once(c, t, lambda c, t: blocking.band_hits(c, t, DEFAULT.time_window_s))
    if number == blocking.NAME:
        table = Tables(spark).write(blocking.by_name(blocking.name_table(c, t, DEFAULT)), "name-keys")
        return blocking.once(c, t, lambda c, t: blocking.name_hits(c, t, table))
    return blocking.key_hits(*blocking.blocking_keys(c, t, DEFAULT, {number})).select("claim_id", "txn_id").distinct()


def _pairs(where: str) -> str:
    return BOTH + f"SELECT DISTINCT c.claim_id, t.txn_id FROM c JOIN t ON {where} AND {TENANT}"


@query(_pairs("c.ref <> '' AND c.ref = t.ref"))
def join_ref_exact(spark, sf):
    return _hits(spark, sf, "REF_EXACT")


@query(_pairs(f"c.ref <> '' AND {CONF.format('c.ref')} = {CONF.format('t.ref')}"))
def join_ref_confusable(spark, sf):
    return _hits(spark, sf, "REF_CONFUSABLE")


@query(_pairs("length(c.ref) >= 6 AND length(t.ref) >= 6 AND right(c.ref, 6) = right(t.ref, 6)"))
def join_ref_suffix(spark, sf):
    return _hits(spark, sf, "REF_SUFFIX")


@query(_pairs("abs(t.occurred_s - c.anchor_s) <= 86400"))
def join_time_band(spark, sf):
    return _hits(spark, sf, "TIME_WINDOW")


@query(_pairs("c.currency = t.currency AND c.amount_minor = t.amount_minor"))
def join_amount_exact(spark, sf):
    return _hits(spark, sf, "AMOUNT_EXACT")


PROBES = """, d AS (SELECT DISTINCT amount_minor AS m, CAST(amount_minor AS VARCHAR) AS s FROM claims WHERE amount_minor IS NOT NULL),
sub(a, b) AS (VALUES ('0','8'),('1','7'),('3','8'),('4','9'),('5','6'),('6','5'),('6','8'),('7','1'),('8','0'),('8','6'),('8','3'),('9','4')),
pr AS (SELECT m, m * 10 AS p FROM d UNION SELECT m, m // 10 FROM d WHERE m % 10 = 0
    UNION SELECT m, CAST(left(s, CAST(i AS INT) - 1) || b || substr(s, CAST(i AS INT) + 1) AS BIGINT) FROM d, generate_series(1, 20) g(i), sub WHERE i <= length(s) AND substr(s, CAST(i AS INT), 1) = a)
"""


@query(BOTH + PROBES + f"SELECT DISTINCT c.claim_id, t.txn_id FROM c JOIN pr ON c.amount_minor = pr.m AND pr.p <> pr.m JOIN t ON t.currency = c.currency AND t.amount_minor = pr.p AND {TENANT}")
def join_amount_probe(spark, sf):
    return _hits(spark, sf, "AMOUNT_NEIGHBOUR")


@query(named_sql.recursive(BOTH + named_sql.KEYS + "SELECT claim_id, txn_id FROM (" + named_sql.HITS.replace("{T}", TENANT) + ")"))
def join_name_key(spark, sf):
    return _hits(spark, sf, "NAME_PHONETIC")


GROUPS = """, h AS (
    SELECT c.claim_id, t.txn_id, 0 AS kind, abs(t.occurred_s - c.anchor_s) AS d FROM c JOIN t ON c.ref <> '' AND c.ref = t.ref AND {T}
    UNION ALL SELECT c.claim_id, t.txn_id, 1, abs(t.occurred_s - c.anchor_s) FROM c JOIN t ON c.ref <> '' AND {CC} = {CT} AND {T}
    UNION ALL SELECT c.claim_id, t.txn_id, 2, abs(t.occurred_s - c.anchor_s) FROM c JOIN t ON length(c.ref) >= 6 AND length(t.ref) >= 6 AND right(c.ref, 6) = right(t.ref, 6) AND {T}
    UNION ALL SELECT c.claim_id, t.txn_id, 3, abs(t.occurred_s - c.anchor_s) FROM c JOIN t ON abs(t.occurred_s - c.anchor_s) <= 86400 AND {T}
    UNION ALL SELECT c.claim_id, t.txn_id, 4, abs(t.occurred_s - c.anchor_s) FROM c JOIN t ON c.currency = t.currency AND c.amount_minor = t.amount_minor AND {T}
    UNION ALL SELECT c.claim_id, t.txn_id, 5, abs(t.occurred_s - c.anchor_s) FROM c JOIN pr ON c.amount_minor = pr.m AND pr.p <> pr.m JOIN t ON t.currency = c.currency AND t.amount_minor = pr.p AND {T}),
g AS (SELECT claim_id, txn_id, min(kind) AS group_rank, min(d) AS abs_delta FROM h GROUP BY ALL),
k AS (SELECT *, count(*) OVER (PARTITION BY claim_id) AS examined, row_number() OVER (PARTITION BY claim_id ORDER BY group_rank, abs_delta, txn_id) AS position FROM g)
""".replace("{T}", TENANT).replace("{CC}", CONF.format("c.ref")).replace("{CT}", CONF.format("t.ref"))


@query(BOTH + PROBES + GROUPS + "SELECT claim_id, txn_id, group_rank, abs_delta, position, examined, examined > 25 AS truncated FROM k WHERE position <= 25")
def blocking_union_top25(spark, sf):
    v = views(spark, sf)
    return blocking.retrieve(anchored(v["claims"]), settled(v), DEFAULT, names=False).drop("kinds")


NAMED_GROUPS = named_sql.groups_with_names(GROUPS, TENANT)
KIND_NAMES = "[" + ", ".join(f"'{k}'" for k in blocking.KINDS) + "]"


@query(
    named_sql.recursive(BOTH + PROBES + NAMED_GROUPS)
    + f"""SELECT k.claim_id, k.txn_id, string_agg({KIND_NAMES}[h.kind + 1], '|' ORDER BY h.kind) AS kinds FROM k JOIN (SELECT DISTINCT claim_id, txn_id, kind FROM h) h ON h.claim_id = k.claim_id AND h.txn_id = k.txn_id
WHERE position <= 25 AND (h.kind > 2 OR h.kind = k.group_rank) GROUP BY ALL"""
)
def candidate_provenance(spark, sf):
    v = views(spark, sf)
    return blocking.retrieve(anchored(v["claims"]), settled(v), DEFAULT).select("claim_id", "txn_id", F.array_join("kinds", "|").alias("kinds"))


# ---- ladders, ranking and the decision without names, which SQL can say in full

LADDERS = """, s AS (SELECT k.claim_id, k.txn_id, c.order_id, c.proof_sha256, c.amount_minor AS ca, t.amount_minor AS ta, c.ref AS cr, t.ref AS tr, c.occurred_s AS c_at, t.occurred_s AS t_at, t.source, c.n, c.date_inferred AS di,
    CASE WHEN t.occurred_s >= c.occurred_s AND t.occurred_s < c.occurred_s + c.granularity_s THEN 0 ELSE least(abs(t.occurred_s - c.occurred_s), abs(t.occurred_s - c.occurred_s - c.granularity_s)) END AS gap
    FROM k JOIN c ON c.claim_id = k.claim_id JOIN t ON t.txn_id = k.txn_id WHERE position <= 25),
z AS (SELECT *, pow(2.0::DOUBLE, -pow(greatest(0.0::DOUBLE, gap - CASE WHEN di THEN 21600 ELSE 120 END) / CASE WHEN di THEN 43200.0::DOUBLE ELSE 900.0::DOUBLE END, 2)) AS sim,
    round_even((c_at - t_at) / 3600.0::DOUBLE, 0) AS hours,
    CASE WHEN cr = '' OR tr = '' THEN 'REF_MISSING' WHEN cr = tr THEN 'REF_EXACT' WHEN {CC} = {CT} THEN 'REF_CONFUSABLE'
        WHEN least(length(cr), length(tr)) >= 4 AND (suffix(cr, tr) OR suffix(tr, cr)) THEN 'REF_SUFFIX'
        WHEN least(length(cr), length(tr)) >= 4 AND (contains(cr, tr) OR contains(tr, cr) OR right(cr, 4) = right(tr, 4)) THEN 'REF_PARTIAL' ELSE 'REF_ELSE' END AS rc,
    CASE WHEN ca IS NULL THEN 'AMT_MISSING' WHEN ca = ta THEN 'AMT_EXACT'
        WHEN (ta > 0 AND ca > ta AND ca % ta = 0 AND regexp_matches(CAST(ca // ta AS VARCHAR), '^10+$')) OR (ca > 0 AND ta > ca AND ta % ca = 0 AND regexp_matches(CAST(ta // ca AS VARCHAR), '^10+$')) THEN 'AMT_SCALED' ELSE 'AMT_ELSE' END AS ac FROM s),
y AS (SELECT *, CASE WHEN NOT di AND sim >= 0.98::DOUBLE THEN 'TS_TIGHT' WHEN NOT di AND sim >= 0.8::DOUBLE THEN 'TS_CLOSE' WHEN sim >= 0.8::DOUBLE THEN 'TS_DATE_ONLY' WHEN sim >= 0.4::DOUBLE THEN 'TS_LOOSE'
        WHEN NOT di AND hours <> 0 AND abs(c_at - t_at - hours * 3600) <= 90 AND abs(hours) <= 14 THEN 'TS_HOUR_ART' ELSE 'TS_ELSE' END AS tc FROM z),
x AS (SELECT *, CASE rc WHEN 'REF_EXACT' THEN 1.0::DOUBLE WHEN 'REF_CONFUSABLE' THEN 0.9::DOUBLE WHEN 'REF_SUFFIX' THEN 0.75::DOUBLE WHEN 'REF_PARTIAL' THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END AS rs,
    CASE ac WHEN 'AMT_EXACT' THEN 1.0::DOUBLE WHEN 'AMT_SCALED' THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END AS asc_,
    CASE tc WHEN 'TS_TIGHT' THEN 1.0::DOUBLE WHEN 'TS_CLOSE' THEN 0.85::DOUBLE WHEN 'TS_DATE_ONLY' THEN 0.6::DOUBLE WHEN 'TS_LOOSE' THEN 0.5::DOUBLE WHEN 'TS_HOUR_ART' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS tsc FROM y),
w AS (SELECT *, round((rs + asc_ + tsc * 0.8::DOUBLE) / (CASE WHEN rc = 'REF_MISSING' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END + CASE WHEN ac = 'AMT_MISSING' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END + 0.8::DOUBLE), 6) AS score FROM x),
r AS (SELECT *, row_number() OVER o AS rnk, coalesce(score - lead(score) OVER o, 1.0::DOUBLE) AS margin, count(*) OVER (PARTITION BY claim_id) AS nc,
    sum(CASE WHEN rc = 'REF_EXACT' THEN 1 ELSE 0 END) OVER (PARTITION BY claim_id) AS ne FROM w WINDOW o AS (PARTITION BY claim_id ORDER BY score DESC, txn_id))
""".replace("{CC}", CONF.format("cr")).replace("{CT}", CONF.format("tr"))
CORE = BOTH + PROBES + GROUPS + LADDERS
NAMED_CORE = named_sql.recursive(BOTH + PROBES + NAMED_GROUPS + named_sql.ladders_with_names(LADDERS))


def _ranked(spark, sf, with_names: bool = False) -> DataFrame:
    v = views(spark, sf)
    c, t = anchored(v["claims"]), settled(v)
    return rank(score_candidates(c, t, candidate_pairs(c, t, DEFAULT, with_names), DEFAULT, with_names))


@query(CORE + "SELECT claim_id, txn_id, rc AS code, rs AS score FROM x")
def ladder_reference(spark, sf):
    return _ranked(spark, sf).select("claim_id", "txn_id", F.col("o_reference.code").alias("code"), F.col("o_reference.score").alias("score"))


@query(CORE + "SELECT claim_id, txn_id, ac AS code, asc_ AS score FROM x")
def ladder_amount(spark, sf):
    return _ranked(spark, sf).select("claim_id", "txn_id", F.col("o_amount.code").alias("code"), F.col("o_amount.score").alias("score"))


@query(CORE + "SELECT claim_id, txn_id, tc AS code, tsc AS score FROM x")
def ladder_timestamp(spark, sf):
    return _ranked(spark, sf).select("claim_id", "txn_id", F.col("o_timestamp.code").alias("code"), F.col("o_timestamp.score").alias("score"))


@query(NAMED_CORE + "SELECT claim_id, txn_id, name_code AS code, round(idf_score, 9) AS idf_score FROM w")
def ladder_name(spark, sf):
    return _ranked(spark, sf, True).select("claim_id", "txn_id", F.col("o_sender_name.code").alias("code"), F.round("m_sender_name.idf_score", 9).alias("idf_score"))


@query(CORE + "SELECT claim_id, txn_id, score, round(margin, 9) AS margin, ne = 1 AND rc = 'REF_EXACT' AND rnk = 1 AS dominant, CAST(rnk AS INT) AS rnk FROM r")
def rank_margin(spark, sf):
    return _ranked(spark, sf).select("claim_id", "txn_id", "score", F.round("margin", 9).alias("margin"), "dominant", "rnk")


@query(CORE + "SELECT claim_id, txn_id, score, round(margin, 9) AS margin, ne = 1 AND rc = 'REF_EXACT' AND rnk = 1 AS dominant, CAST(rnk AS INT) AS rnk, CAST(nc AS BIGINT) AS n_candidates FROM r")
def rank_margin_whole(spark, sf):
    """Every rank of every claim, with its number of candidates."""
    return _ranked(spark, sf).select("claim_id", "txn_id", "score", F.round("margin", 9).alias("margin"), "dominant", "rnk", "n_candidates")


RULES = """, al AS (SELECT txn_id, arg_min(order_id, (coalesce(allocated_s, -62135596800), order_id, coalesce(verification_id, ''))) AS o FROM allocations WHERE status = 'ACTIVE' GROUP BY 1),
q AS (SELECT c.claim_id, c.order_id AS oid, c.n AS cn, c.amount_minor AS cam, r.*, e.expected_minor AS em, al.o AS ao, p.sha256 IS NOT NULL AND NOT (p.order_id IS NOT NULL AND c.order_id IS NOT NULL AND p.order_id = c.order_id) AS reused,
    coalesce(r.score, 0.0::DOUBLE) AS sc, coalesce(r.score >= 0.45::DOUBLE, false) AS cmp
    FROM c LEFT JOIN r ON r.claim_id = c.claim_id AND rnk = 1 LEFT JOIN expected e ON e.order_id = c.order_id LEFT JOIN al ON al.txn_id = r.txn_id LEFT JOIN proofs p ON p.sha256 = c.proof_sha256),
u AS (SELECT *, nc >= 2 AND margin < 0.1::DOUBLE AND NOT (ne = 1 AND rc = 'REF_EXACT') AS ind, rc = 'REF_ELSE' OR ac IN ('AMT_SCALED', 'AMT_ELSE') OR tc = 'TS_ELSE' AS con,
    cmp AND cam - ta > 0 AND cam - ta >= 5000 AND cam - ta >= ta * 0.01 AS mi, cmp AND ta - em > 0 AND ta - em >= 20000 AND ta - em >= em AS mo FROM q),
f AS (SELECT *, CASE WHEN txn_id IS NULL THEN 'R010' WHEN ao IS NOT NULL AND (oid IS NULL OR oid <> ao) THEN 'R020' WHEN reused THEN 'R025' WHEN mi THEN 'R030'
    WHEN cn % 35 = 10 AND sc < 0.82::DOUBLE THEN 'R040' WHEN ind AND sc >= 0.45::DOUBLE THEN 'R050' WHEN sc < 0.45::DOUBLE THEN 'R060'
    WHEN sc >= 0.82::DOUBLE AND source IN ('MERCHANT_CSV', 'MANUAL_ENTRY') THEN 'R065' WHEN sc >= 0.82::DOUBLE AND cn % 45 = 0 THEN 'R067'
    WHEN sc >= 0.82::DOUBLE AND em - ta > 0 THEN 'R070' WHEN sc >= 0.82::DOUBLE AND mo THEN 'R072' WHEN con THEN 'R075' WHEN sc >= 0.82::DOUBLE AND em - ta < 0 THEN 'R080' WHEN sc >= 0.82::DOUBLE THEN 'R090' ELSE 'R999' END AS fired FROM u),
v AS (SELECT *, CASE WHEN fired IN ('R010', 'R060') THEN 'UNMATCHED' WHEN fired IN ('R020', 'R025') THEN 'DUPLICATE' WHEN fired IN ('R030', 'R040') THEN 'SUSPICIOUS' WHEN fired IN ('R080', 'R090') THEN 'VERIFIED' ELSE 'NEEDS_REVIEW' END AS status FROM f)
"""
DECIDE = CORE.replace("WITH ledger AS", duck_ctes("expected", "allocations", "proofs") + ", ledger AS", 1) + RULES
NAMED_DECIDE = NAMED_CORE.replace("WITH RECURSIVE ledger AS", named_sql.recursive(duck_ctes("expected", "allocations", "proofs")) + ", ledger AS", 1) + named_sql.decisions_with_names(RULES)


def decided_core(spark, sf) -> DataFrame:
    v = views(spark, sf)
    return decide(v["claims"], v["expected"], settled(v), tables.active_allocations(v["allocations"]), v["proofs"], names=False)


def decided_full(spark, sf) -> DataFrame:
    v = views(spark, sf)
    return decide(v["claims"], v["expected"], settled(v), tables.active_allocations(v["allocations"]), v["proofs"])


@query(DECIDE + "SELECT claim_id, fired AS fired_rule_id, status, round(sc, 6) AS best_score, CASE WHEN status = 'UNMATCHED' OR coalesce(ind, false) OR fired = 'R025' THEN NULL ELSE txn_id END AS matched_txn_id FROM v")
def decide_core(spark, sf):
    return decided_core(spark, sf).select("claim_id", "fired_rule_id", "status", "best_score", "matched_txn_id")


@query(DECIDE + "SELECT claim_id, CASE WHEN NOT cmp OR em IS NULL THEN 'UNKNOWN' WHEN em = ta THEN 'EXACT' WHEN em > ta THEN 'UNDER' ELSE 'OVER' END AS relation, CASE WHEN NOT cmp OR cam IS NULL THEN 'UNKNOWN' WHEN cam = ta THEN 'CONSISTENT' WHEN cam > ta THEN 'INFLATED' ELSE 'DEFLATED' END AS integrity, CASE WHEN cmp THEN em - ta END AS shortfall_minor, coalesce(mi, false) AS material_inflation, coalesce(mo, false) AS material_overpayment FROM v")
def amount_semantics(spark, sf):
    return decided_core(spark, sf).select("claim_id", "relation", "integrity", "shortfall_minor", "material_inflation", "material_overpayment")


@query(DECIDE + "SELECT " + ", ".join(f"sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END)::BIGINT AS {s.lower()}" for s in aggregates.STATUSES) + ", count(*) AS total_checked, coalesce(sum(CASE WHEN status = 'VERIFIED' THEN cam END), 0)::BIGINT AS verified_amount_minor FROM v")
def dashboard(spark, sf):
    return aggregates.status_counts(decided_core(spark, sf))


@query(DECIDE.replace("c.order_id AS oid", "c.merchant_id AS cmid, c.order_id AS oid") + "SELECT cmid AS merchant_id, count_if(status = 'VERIFIED')::BIGINT AS verified, count_if(status IN ('SUSPICIOUS', 'DUPLICATE'))::BIGINT AS blocked, count_if(status IN ('NEEDS_REVIEW', 'UNMATCHED'))::BIGINT AS review FROM v GROUP BY 1")
def nav_tally(spark, sf):
    return aggregates.nav_tally(decided_core(spark, sf))


@query(DECIDE.replace("c.order_id AS oid", "c.now_s AS cnow, c.order_id AS oid") + "SELECT claim_id, status, cnow AS now_s FROM v ORDER BY cnow DESC, claim_id DESC LIMIT 50")
def history_top(spark, sf):
    return aggregates.history(decided_core(spark, sf)).select("claim_id", "status", "now_s")


@query(NAMED_DECIDE + f"SELECT claim_id, status, risk, fired AS fired_rule_id, confidence, sc AS best_score, array_to_string(reasons, '|') AS reasons, matched_txn_id, array_to_string(observations, '|') AS observations, violation, '{DEFAULT.fingerprint()}' AS policy_fingerprint FROM dx")
def decide_full(spark, sf):
    return decided_full(spark, sf).select("claim_id", "status", "risk", "fired_rule_id", "confidence", "best_score", F.array_join("reasons", "|").alias("reasons"), "matched_txn_id", F.array_join("observations", "|").alias("observations"), "violation", "policy_fingerprint")


@query(NAMED_DECIDE + named_sql.EVIDENCE + named_sql.ROWS + "SELECT claim_id, field, label, claimed, actual, verdict, level_code, mark FROM er")
def explain_rows(spark, sf):
    e = explain.explain(decided_full(spark, sf))
    return e.select("claim_id", F.explode("rows").alias("r")).select("claim_id", "r.*")


@query(NAMED_DECIDE + named_sql.EVIDENCE + named_sql.ROWS + named_sql.WORDS + "SELECT claim_id, headline, summary, action, text FROM ex")
def summary_text(spark, sf):
    return explain.explain(decided_full(spark, sf)).select("claim_id", "headline", "summary", "action", "text")


@query(NAMED_DECIDE + named_sql.EVIDENCE + named_sql.ROWS + named_sql.WORDS + named_sql.API)
def api_results(spark, sf):
    return explain.api_result(decided_full(spark, sf))


@query(CORE + "SELECT ac || '|' || rc || '|' || tc AS pattern, count(*) AS claims, min(claim_id) AS first_claim FROM r WHERE rnk = 1 GROUP BY 1")
def pattern_clusters(spark, sf):
    return aggregates.pattern_clusters(decided_core(spark, sf))


@query(CORE + "SELECT claim_id, CAST((rc IN ('REF_EXACT', 'REF_CONFUSABLE', 'REF_SUFFIX'))::INT + (ac = 'AMT_EXACT')::INT + (tc IN ('TS_TIGHT', 'TS_CLOSE'))::INT AS INT) AS agreeing, 3 AS rows FROM r WHERE rnk = 1 UNION ALL SELECT claim_id, 0, 0 FROM c WHERE claim_id NOT IN (SELECT claim_id FROM r)")
def row_match_count(spark, sf):
    return aggregates.row_match_count(decided_core(spark, sf))


# ---- conflicts


@query(
    duck_ctes("allocations")
    + """ SELECT txn_id, arg_min(order_id, (coalesce(allocated_s, -62135596800), order_id, coalesce(verification_id, ''))) AS order_id, count(*) > 1 AS contested FROM allocations WHERE status = 'ACTIVE' GROUP BY 1"""
)
def earliest_alloc(spark, sf):
    return conflicts.earliest_allocations(tables.active_allocations(views(spark, sf)["allocations"])).select("txn_id", "order_id", "contested")


@query(
    duck_ctes("ledger", "allocations", "claims")
    + """, f AS (SELECT txn_id, arg_min(order_id, (coalesce(allocated_s, -62135596800), order_id, coalesce(verification_id, ''))) AS o FROM allocations WHERE status = 'ACTIVE' GROUP BY 1)
SELECT c.claim_id, t.txn_id, f.o AS allocated_to, f.o IS NOT NULL AND (c.order_id IS NULL OR c.order_id <> f.o) AS conflict FROM claims c JOIN ledger t ON t.txn_id = 'TX' || substr(c.claim_id, 3) LEFT JOIN f ON f.txn_id = t.txn_id"""
)
def alloc_conflict(spark, sf):
    v = views(spark, sf)
    own = v["claims"].select("claim_id", "order_id", F.concat(F.lit("TX"), F.col("claim_id").substr(F.lit(3), F.length("claim_id"))).alias("txn_id")).join(v["ledger"].select("txn_id"), "txn_id", "left_semi")
    return conflicts.allocation_conflicts(own, tables.active_allocations(v["allocations"])).select("claim_id", "txn_id", "allocated_to", "conflict")


@query(
    duck_ctes("submissions")
    + """, f AS (SELECT sha256, arg_min(order_id, (submitted_s, order_id)) AS o FROM submissions GROUP BY 1)
SELECT s.order_id AS claim_id, s.order_id <> f.o AS reused, CASE WHEN s.order_id <> f.o THEN f.o END AS reused_name FROM submissions s JOIN f USING (sha256)"""
)
def proof_conflict(spark, sf):
    s = views(spark, sf)["submissions"]
    proofs = s.select("sha256", "order_id", F.lit(None).cast("string").alias("order_ref"), F.lit(None).cast("string").alias("verification_id"), "submitted_s")
    claims = s.select(F.col("order_id").alias("claim_id"), F.col("sha256").alias("proof_sha256"), "order_id")
    return conflicts.proof_conflicts(claims, proofs).select("claim_id", "reused", "reused_name")


# ---- document frequencies

NAME_DOCS = duck_ctes("ledger") + """, d AS (SELECT merchant_id, unnest([sender_name, receiver_name]) AS name FROM ledger WHERE status = 'POSTED'),
e AS (SELECT row_number() OVER () AS i, merchant_id, string_split(name, ' ') AS toks FROM d WHERE name IS NOT NULL AND name <> ''),
n AS (SELECT merchant_id, count(*) AS n FROM e GROUP BY 1), tk AS (SELECT DISTINCT i, merchant_id, unnest(toks) AS token FROM e), df AS (SELECT merchant_id, token, count(*) AS df FROM tk GROUP BY ALL),
com AS (SELECT unnest(['muhammad','ali','ahmad','khan','hussain','hassan','abdul','syed','fatima','ayesha','bibi']) AS token),
v AS (SELECT df.merchant_id, token, df, CASE WHEN token IN (SELECT token FROM com) THEN 0.15::DOUBLE ELSE greatest(0.15::DOUBLE, least(1.0::DOUBLE, ln(n / (1.0::DOUBLE + df)) / CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE ln(n) END)) END AS idf FROM df JOIN n ON df.merchant_id IS NOT DISTINCT FROM n.merchant_id),
a AS (SELECT * FROM v UNION ALL SELECT n.merchant_id, com.token, 0, 0.15::DOUBLE FROM n, com WHERE NOT EXISTS (SELECT 1 FROM df WHERE df.merchant_id IS NOT DISTINCT FROM n.merchant_id AND df.token = com.token))
SELECT merchant_id, token, df, round(idf, 9) AS idf FROM a"""


@query(NAME_DOCS)
def idf_blocking(spark, sf):
    return idf.idf(idf.name_documents(settled(views(spark, sf))), 0.15, scoring=False).withColumn("idf", F.round("idf", 9))


@query(NAME_DOCS)
def idf_scoring(spark, sf):
    return idf.idf(idf.name_documents(settled(views(spark, sf))), 0.15, scoring=True).withColumn("idf", F.round("idf", 9))


# ---- scalars: values are printed in many forms and must come back


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS minor FROM orders")
def parse_amounts(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    value = F.round("o_totalprice", 2).cast("decimal(18,2)")
    plain, grouped = value.cast("string"), F.format_number(value, 2)
    european = F.translate(F.translate(F.translate(grouped, ",", "#"), ".", ","), "#", ".")
    k = F.col("o_orderkey") % 6
    shown = F.when(k == 0, plain).when(k == 1, F.concat(F.lit("Rs. "), grouped)).when(k == 2, F.concat(F.lit("PKR "), european)).when(k == 3, F.concat(grouped, F.lit(" only"))).when(k == 4, F.translate(F.concat(F.lit("₨ "), plain), "0123456789", "٠١٢٣٤٥٦٧٨٩")).otherwise(F.concat(F.lit("Rs "), F.translate(plain, "0", "O")))
    return o.select("o_orderkey", amounts.to_minor(amounts.parse_amount_text(shown)["value"]).alias("minor"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 86400 WHEN o_orderkey % 4 = 1 THEN 60 ELSE 1 END AS granularity_s, CAST(epoch(o_orderdate) AS BIGINT) + CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE (o_orderkey * 7919) % 1440 * 60 END - 18000 AS resolved_s FROM orders")
def parse_timestamps(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    at = F.timestamp_seconds(F.unix_timestamp("o_orderdate") + (F.col("o_orderkey") * 7919) % 1440 * 60)
    k = F.col("o_orderkey") % 4
    shown = F.when(k == 0, F.date_format(at, "dd MMM yyyy, hh:mm a")).when(k == 1, F.date_format(at, "dd/MM/yyyy HH:mm")).when(k == 2, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(at, "dd-MM-yyyy"))
    p = times.parse_timestamp(shown)
    return o.select("o_orderkey", p["granularity_s"].alias("granularity_s"), p["resolved_s"].alias("resolved_s"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE '03' || lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR), 9, '0') END AS phone FROM customer")
def normalize_phones(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    tail = F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0")
    k = F.col("c_custkey") % 5
    shown = F.when(k == 0, F.concat(F.lit("03"), tail)).when(k == 1, F.concat(F.lit("+92 3"), tail)).when(k == 2, F.concat(F.lit("923"), tail)).when(k == 3, F.concat(F.lit("03"), F.substring(tail, 1, 2), F.lit("-"), F.substring(tail, 3, 7))).otherwise(F.concat(F.lit("04"), tail))
    return c.select("c_custkey", text.normalize_msisdn(shown).alias("phone"))


@query("SELECT o_orderkey, CASE WHEN minor % 100 = 0 THEN 'Rs ' || format('{:,}', minor // 100) ELSE 'Rs ' || format('{:,}', minor // 100) || '.' || lpad(CAST(minor % 100 AS VARCHAR), 2, '0') END AS shown FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS minor FROM orders)")
def money_display(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", amounts.format_money(F.round(F.col("o_totalprice") * 100).cast("long")).alias("shown"))


@query(duck_ctes("claims") + f" SELECT claim_id, {REF.format('reference_id')} AS ref, {CONF.format(REF.format('reference_id'))} AS conf FROM claims")
def normalize_references(spark, sf):
    return blocking.with_keys(views(spark, sf)["claims"], F.col("reference_id")).select("claim_id", F.col("ref_norm").alias("ref"), F.col("ref_conf").alias("conf"))


@query(duck_ctes("ledger") + " SELECT txn_id, array_to_string(list_filter(string_split(sender_name, ' '), lambda x: x <> ''), ' ') AS tokens FROM ledger")
def normalize_names(spark, sf):
    l = views(spark, sf)["ledger"]
    honoured = F.concat(F.lit("Mr. "), F.initcap("sender_name"))
    return l.select("txn_id", F.array_join(names.name_tokens(honoured), " ").alias("tokens"))


@query("SELECT l_orderkey, l_linenumber, round(pow(2.0::DOUBLE, -pow(greatest(0.0::DOUBLE, l_quantity - 10) / 15.0::DOUBLE, 2)), 12) AS gauss, round(pow(2.0::DOUBLE, -(greatest(0.0::DOUBLE, l_quantity - 10) / 15.0::DOUBLE)), 12) AS exponential, CASE WHEN round_even((l_partkey * 37 - 40000) / 3600.0::DOUBLE, 0) <> 0 AND abs(l_partkey * 37 - 40000 - 3600 * round_even((l_partkey * 37 - 40000) / 3600.0::DOUBLE, 0)) <= 90 AND abs(round_even((l_partkey * 37 - 40000) / 3600.0::DOUBLE, 0)) <= 14 THEN CAST(round_even((l_partkey * 37 - 40000) / 3600.0::DOUBLE, 0) AS INT) END AS hours FROM lineitem")
def decay_and_hours(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    ten, fifteen = F.lit(10.0), F.lit(15.0)
    return l.select("l_orderkey", "l_linenumber", F.round(times.gauss(F.col("l_quantity"), ten, fifteen), 12).alias("gauss"), F.round(times.exponential(F.col("l_quantity"), ten, fifteen), 12).alias("exponential"), times.hour_offset((F.col("l_partkey") * 37 - 40000).cast("double"), 90.0).alias("hours"))


@query(duck_ctes("claims") + PROBES + "SELECT m AS minor, p AS probe FROM pr WHERE p <> m")
def amount_probes(spark, sf):
    c = views(spark, sf)["claims"].where("amount_minor is not null").select(F.col("amount_minor").alias("minor")).distinct()
    return c.select("minor", F.explode(amounts.amount_probes(F.col("minor"))).alias("probe"))


@query("WITH t AS (SELECT DISTINCT n_name AS x FROM nation), p AS (SELECT lower(a.x) AS a, lower(b.x) AS b FROM t a, t b) SELECT a, b, round(jaro_winkler_similarity(a, b), 9) AS sim FROM p")
def jaro_winkler(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.lower("n_name").alias("a")).distinct()
    return n.crossJoin(n.withColumnRenamed("a", "b")).withColumn("sim", F.round(names.jaro_winkler(F.col("a"), F.col("b")), 9))


# ---- reports and workflow


@query(
    duck_ctes("claims")
    + """, x AS (SELECT 'amount' AS field, CAST(o.minor AS VARCHAR) AS truth, CAST(c.amount_minor AS VARCHAR) AS read FROM claims c JOIN (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS minor FROM orders) o ON o.o_orderkey = c.n
UNION ALL SELECT 'reference', 'TID: ' || CASE n % 3 WHEN 0 THEN 'EP' WHEN 1 THEN 'JC' ELSE 'RA' END || lpad(CAST(n AS VARCHAR), 8, '0'), reference_id FROM claims)
SELECT field, count(*) AS n, count_if(truth = read)::BIGINT AS correct, count_if(read IS NULL)::BIGINT AS missing, count_if(read IS NOT NULL AND read <> truth)::BIGINT AS wrong, count_if(truth = read) / count(*)::DOUBLE AS accuracy, count_if(read IS NOT NULL AND read <> truth) / count(*)::DOUBLE AS dangerous FROM x GROUP BY 1"""
)
def extraction_accuracy(spark, sf):
    v = views(spark, sf)
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("n"), F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("truth"))
    ext = F.concat(F.when(F.col("n") % 3 == 0, "EP").when(F.col("n") % 3 == 1, "JC").otherwise("RA"), F.lpad(F.col("n").cast("string"), 8, "0"))
    a = v["claims"].join(o, "n").select(F.lit("amount").alias("field"), "truth", F.col("amount_minor").cast("string").alias("read"))
    r = v["claims"].select(F.lit("reference").alias("field"), F.concat(F.lit("TID: "), ext).alias("truth"), F.col("reference_id").alias("read"))
    return aggregates.extraction_accuracy(a.unionByName(r))


@query("SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'NEW' WHEN fp = first_value(fp) OVER w THEN 'REPLAY' ELSE 'CONFLICT' END AS outcome FROM (SELECT *, 'M' || CAST(user_id % 5 AS VARCHAR) AS m, 'K' || CAST(event_id % 4000 AS VARCHAR) AS k, sha256(event_type || ':' || CAST(event_id % 4000 AS VARCHAR)) AS fp FROM events) WINDOW w AS (PARTITION BY m, k ORDER BY event_id, fp)")
def idempotent_replay(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = (F.col("event_id") % 4000).cast("string")
    r = e.select("event_id", F.concat(F.lit("M"), (F.col("user_id") % 5).cast("string")).alias("merchant_id"), F.concat(F.lit("K"), k).alias("key"), text.request_fingerprint(F.col("event_type"), k).alias("fingerprint"), F.col("event_id").alias("at_s"))
    return workflow.idempotent_submit(r).select("event_id", "outcome")


@query(NAMED_DECIDE + named_sql.APPROVED)
def approve_first_wins(spark, sf):
    v = views(spark, sf)
    return workflow.approve(decided_full(spark, sf), tables.active_allocations(v["allocations"]))


@query(NAMED_DECIDE + named_sql.EVIDENCE + "SELECT claim_id, field, code AS evidence_code, CASE agreement WHEN 'AGREE' THEN 'PASS' WHEN 'CONTRADICT' THEN 'FAIL' WHEN 'WEAK' THEN 'WARNING' ELSE 'UNKNOWN' END AS outcome, score FROM ev")
def stored_evidence(spark, sf):
    return workflow.stored_evidence(decided_full(spark, sf))


@query("SELECT user_id AS order_id, time_bucket(INTERVAL 15 MINUTES, ts) AS window_start, count(*) AS attempts FROM events GROUP BY ALL HAVING count(*) > 1")
def attempts_window(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("order_id"), "ts")
    return streaming.attempts_window(e, most=1)


@query("WITH s AS (SELECT l_quantity::INT AS value, count_if(l_returnflag = 'R' AND l_quantity > 25 AND l_quantity < 20)::BIGINT + CASE WHEN l_quantity BETWEEN 10 AND 30 OR l_quantity > 40 THEN 0 ELSE 1 END AS failures FROM lineitem GROUP BY l_quantity), m AS (SELECT *, row_number() OVER (ORDER BY value) AS pos, min(failures) OVER () AS low FROM s), r AS (SELECT value, pos - row_number() OVER (ORDER BY value) AS island FROM m WHERE failures = low), i AS (SELECT min(value) AS first, max(value) AS last, count(*) AS width FROM r GROUP BY island) SELECT first, last, width FROM i ORDER BY width DESC, first DESC LIMIT 1")
def plateau(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_quantity").cast("int").alias("value")).agg(F.lit(0).alias("z"))
    good = F.col("value").between(10, 30) | (F.col("value") > 40)
    return aggregates.plateau(l.select("value", F.when(good, 0).otherwise(1).alias("failures")))


@query()
def policy_sweep(spark, sf):
    v = views(spark, sf)
    return sweep.sensitivity(sweep.sweep_all(v["claims"], v["expected"], settled(v), tables.active_allocations(v["allocations"]), v["proofs"]))


#: The grids of the knobs that rules and their context alone read, as rows of whole policies.
CORE_GRIDS = {k: sweep.GRIDS[k] for k in sorted(DECISION_KNOBS)}


def _policy_rows() -> str:
    fields = sorted(DECISION_KNOBS)
    rows = [("", 0.0, {})] + [(k, x, {k: x}) for k, values in CORE_GRIDS.items() for x in values]
    shown = [f"('{k}', {float(x)!r}, {', '.join(repr(float((moved.get(f, getattr(DEFAULT, f))))) for f in fields)})" for k, x, moved in rows]
    return f"pol AS (SELECT knob, point, {', '.join(f'{f}::DOUBLE AS {f}' for f in fields)} FROM (VALUES {', '.join(shown)}) x (knob, point, {', '.join(fields)})), "


def _sweep_sql() -> str:
    """DECIDE with the columns of a policy in place of its numbers; the first row of pol is the baseline."""
    changes = [
        (", al AS (SELECT txn_id", ", " + _policy_rows() + "al AS (SELECT txn_id"),
        ("coalesce(r.score >= 0.45::DOUBLE, false) AS cmp\n    FROM c LEFT JOIN r", "coalesce(r.score >= pol.tau_reject, false) AS cmp, pol.*\n    FROM c CROSS JOIN pol LEFT JOIN r"),
        ("margin < 0.1::DOUBLE", "margin < tau_margin"),
        ("cam - ta >= 5000 AND cam - ta >= ta * 0.01", "cam - ta >= inflation_material_minor AND cam - ta >= ta * inflation_material_pct::DECIMAL(10, 4)"),
        ("ta - em >= 20000 AND ta - em >= em AS mo", "ta - em >= overpayment_material_minor AND ta - em >= em * overpayment_material_pct::DECIMAL(10, 4) AS mo"),
        ("cn % 35 = 10 AND sc", "CASE WHEN cn % 35 = 10 THEN 2 ELSE 0 END > tamper_signal_limit AND sc"),
        ("ind AND sc >= 0.45::DOUBLE", "ind AND sc >= tau_ambiguous"),
        ("sc < 0.45::DOUBLE", "sc < tau_reject"),
        ("0.82::DOUBLE", "tau_accept"),
        ("cn % 45 = 0", "cn % 45 = 0 AND 0.5 < min_field_confidence"),
    ]
    sql = DECIDE
    for old, new in changes:
        if old not in sql:
            raise ValueError(old)
        sql = sql.replace(old, new)
    # The rules whose own reasons are codes of amounts too.
    reasons = "WHEN 'R030' THEN ['CLAIM_INFLATED'] WHEN 'R070' THEN ['AMOUNT_UNDERPAID'] WHEN 'R072' THEN ['AMOUNT_OVERPAID_MATERIAL'] WHEN 'R080' THEN ['AMOUNT_OVERPAID']"
    return (
        sql
        + f""", told AS (SELECT *, list_sort(list_distinct(list_concat(CASE fired {reasons} ELSE []::VARCHAR[] END, CASE WHEN cmp THEN [
            CASE WHEN em IS NULL THEN 'MISSING_ORDER_AMOUNT' WHEN em = ta THEN 'AMOUNT_EXACT' WHEN em > ta THEN 'AMOUNT_UNDERPAID' ELSE 'AMOUNT_OVERPAID' END,
            CASE WHEN em < ta AND mo THEN 'AMOUNT_OVERPAID_MATERIAL' ELSE 'none' END,
            CASE WHEN cam IS NULL THEN 'none' WHEN cam = ta THEN 'CLAIM_CONSISTENT' WHEN cam > ta THEN 'CLAIM_INFLATED' ELSE 'CLAIM_DEFLATED' END] ELSE []::VARCHAR[] END))) AS why FROM v),
        moved AS (SELECT a.knob, a.point, a.tau_reject > a.tau_accept AS refused, a.status <> b.status AS flip, a.fired <> b.fired OR a.why <> b.why AS other
            FROM told a JOIN told b ON b.knob = '' AND b.claim_id = a.claim_id WHERE a.knob <> '')
        SELECT knob, point AS value, refused, CASE WHEN refused THEN 0 ELSE count(*) END AS cases, CASE WHEN refused THEN 0 ELSE count_if(flip) END AS status_flips,
            CASE WHEN refused THEN 0 ELSE count_if(NOT flip AND other) END AS explanation_flips FROM moved GROUP BY knob, point, refused"""
    )


@query(_sweep_sql())
def policy_sweep_core(spark, sf):
    """Every value of the knobs of decisions, names off."""
    v = views(spark, sf)
    return sweep.sweep_all(v["claims"], v["expected"], settled(v), tables.active_allocations(v["allocations"]), v["proofs"], CORE_GRIDS, names=False)


# ---- list views, coverage and the remaining helpers


@query(DECIDE.replace("c.order_id AS oid", "c.now_s AS cnow, c.order_id AS oid") + "SELECT claim_id, status FROM v WHERE status = 'NEEDS_REVIEW' ORDER BY cnow DESC, claim_id DESC LIMIT 20")
def list_filter(spark, sf):
    return reports.list_view(decided_core(spark, sf), 20, status="NEEDS_REVIEW")[0].select("claim_id", "status")


@query(DECIDE + "SELECT claim_id, status, CAST(list_position(['SUSPICIOUS', 'DUPLICATE', 'NEEDS_REVIEW', 'UNMATCHED', 'VERIFIED'], status) AS BIGINT) AS severity FROM v")
def history_sorted(spark, sf):
    return aggregates.by_severity(decided_core(spark, sf)).select("claim_id", "status", "severity")


@query(
    CORE.replace("WITH ledger AS", duck_ctes("allocations") + ", ledger AS", 1)
    + """, al AS (SELECT txn_id AS atx, arg_min(order_id, (coalesce(allocated_s, -62135596800), order_id, coalesce(verification_id, ''))) AS o, count(*) > 1 AS con FROM allocations WHERE status = 'ACTIVE' GROUP BY 1),
j AS (SELECT r.*, o, con, o IS NOT NULL AND (order_id IS NULL OR order_id <> o) AS bad FROM r LEFT JOIN al ON atx = txn_id)
SELECT claim_id, coalesce(string_agg(txn_id, '|' ORDER BY rnk) FILTER (bad), '') AS conflicts, coalesce(string_agg(txn_id, '|' ORDER BY rnk) FILTER (NOT bad), '') AS free, coalesce(string_agg(txn_id, '|' ORDER BY rnk) FILTER (con), '') AS contested, max(o) FILTER (bad AND rnk = 1) AS best_conflict FROM j GROUP BY 1"""
)
def ranking_duplicates(spark, sf):
    v = views(spark, sf)
    d = reports.ranking_duplicates(_ranked(spark, sf).select("claim_id", "order_id", "txn_id", "rnk"), tables.active_allocations(v["allocations"]))
    return d.select("claim_id", *[F.array_join(c, "|").alias(c) for c in ("conflicts", "free", "contested")], "best_conflict")


@query(NAMED_DECIDE + named_sql.COVERED)
def reason_coverage(spark, sf):
    return reports.reason_coverage(decided_full(spark, sf)).withColumn("rules", F.array_join("rules", "|"))


@query("SELECT a.status, b.status AS other_status, count(*) AS claims, min(a.claim_id) AS first_claim FROM (" + NAMED_DECIDE + "SELECT claim_id, status FROM dx) a JOIN (" + DECIDE + "SELECT claim_id, status FROM v) b ON a.claim_id = b.claim_id GROUP BY ALL")
def names_cross_check(spark, sf):
    return reports.cross_check(decided_full(spark, sf), decided_core(spark, sf))


@query(
    duck_ctes("expected", "allocations")
    + """, h AS (SELECT order_id, count(*) AS k FROM allocations GROUP BY 1)
SELECT order_id, 'MISSING' AS problem FROM (SELECT DISTINCT order_id FROM expected) w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.order_id = w.order_id)
UNION ALL SELECT order_id, 'EXTRA' FROM h WHERE NOT EXISTS (SELECT 1 FROM expected w WHERE w.order_id = h.order_id)
UNION ALL SELECT order_id, 'DUPLICATE' FROM h WHERE k > 1"""
)
def missing_orders(spark, sf):
    """All expected orders against all allocations: orders without one, unknown ones, those allocated more than once."""
    v = views(spark, sf)
    return reports.missing_keys(v["expected"], v["allocations"], "order_id")


@query(
    duck_ctes("ledger", "allocations")
    + """, h AS (SELECT txn_id, count(*) AS k FROM allocations GROUP BY 1)
SELECT txn_id, 'MISSING' AS problem FROM (SELECT DISTINCT txn_id FROM ledger) w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.txn_id = w.txn_id)
UNION ALL SELECT txn_id, 'EXTRA' FROM h WHERE NOT EXISTS (SELECT 1 FROM ledger w WHERE w.txn_id = h.txn_id)
UNION ALL SELECT txn_id, 'DUPLICATE' FROM h WHERE k > 1"""
)
def allocation_problems(spark, sf):
    """The whole ledger against all allocations: transactions without one, unknown ones, those allocated more than once."""
    v = views(spark, sf)
    return reports.missing_keys(v["ledger"], v["allocations"], "txn_id")


@query("WITH s AS (SELECT p_partkey, p_size * 41 AS w, p_size * 97 AS h FROM part), r AS (SELECT *, greatest(32, CAST(round_even(w / 32.0::DOUBLE, 0) AS INT) * 32) AS a, greatest(32, CAST(round_even(h / 32.0::DOUBLE, 0) AS INT) * 32) AS b FROM s), z AS (SELECT *, CASE WHEN a * b > 1003520 THEN greatest(32, CAST(floor(w / sqrt(w * h / 1003520.0::DOUBLE) / 32) AS INT) * 32) WHEN a * b < 3136 THEN CAST(ceil(w * sqrt(3136.0::DOUBLE / (w * h)) / 32) AS INT) * 32 ELSE a END AS width, CASE WHEN a * b > 1003520 THEN greatest(32, CAST(floor(h / sqrt(w * h / 1003520.0::DOUBLE) / 32) AS INT) * 32) WHEN a * b < 3136 THEN CAST(ceil(h * sqrt(3136.0::DOUBLE / (w * h)) / 32) AS INT) * 32 ELSE b END AS height FROM r) SELECT p_partkey, width, height, CAST(width / 32 * height / 32 AS INT) AS tokens FROM z")
def smart_resize(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", misc.smart_resize(F.col("p_size") * 41, F.col("p_size") * 97).alias("s"))
    return p.select("p_partkey", F.col("s.width").alias("width"), F.col("s.height").alias("height"), misc.image_tokens(F.col("s")).alias("tokens"))


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor, CAST(epoch(o_orderdate) AS BIGINT) + (o_orderkey * 7919) % 1440 * 60 - 18000 AS occurred_s, false AS date_inferred FROM orders WHERE o_orderkey % 5 <> 4 UNION ALL SELECT o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderkey % 5 = 4")
def extract_claims(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    at = F.timestamp_seconds(F.unix_timestamp("o_orderdate") + (F.col("o_orderkey") * 7919) % 1440 * 60)
    raw = o.select(
        F.col("o_orderkey").cast("string").alias("claim_id"), F.lit("EASYPAISA").alias("provider"), F.concat(F.lit("Rs. "), F.format_number(F.round("o_totalprice", 2).cast("decimal(18,2)"), 2)).alias("amount"),
        F.lit("A B").alias("sender_name"), F.lit(None).cast("string").alias("receiver_name"), F.lit("EP1").alias("reference_id"), F.date_format(at, "dd MMM yyyy, hh:mm a").alias("timestamp"),
        F.when(F.col("o_orderkey") % 5 == 4, "TIMEOUT").alias("error_kind"),
    )
    c = tables.extract_claims(raw)
    return c.select(F.col("claim_id").cast("long").alias("o_orderkey"), "amount_minor", "occurred_s", "date_inferred")


@query("SELECT l_returnflag AS status, l_linestatus AS band, count(*) AS items, count_if(l_quantity > 25)::BIGINT AS large, min(l_orderkey) AS first_order FROM lineitem GROUP BY ALL")
def category_counts(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet").withColumnsRenamed({"l_returnflag": "status", "l_linestatus": "band"})
    return aggregates.category_counts(l, ["status", "band"], F.col("l_quantity") > 25, "l_orderkey").withColumnsRenamed({"flagged": "large", "first_id": "first_order"})


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) - CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 18000 END AS at_s FROM orders")
def readings_in_utc(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", tables.in_utc(F.col("o_orderdate"), F.when(F.col("o_orderkey") % 3 == 0, "UTC")).alias("at_s"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 4 <> 1 END AS amount_ok, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 4 <> 2 END AS reference_ok FROM orders")
def field_validity(spark, sf):
    o, k = spark.read.parquet(f"{sf}/orders.parquet"), F.col("o_orderkey") % 4
    amount = F.when(k == 1, "unreadable").when(k != 3, F.concat(F.lit("Rs "), F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string")))
    reference = F.when(k == 2, "--").when(k != 3, F.concat(F.lit("TID: EP"), F.col("o_orderkey")))
    return o.select("o_orderkey", tables.field_valid("amount", amount).alias("amount_ok"), tables.field_valid("reference_id", reference).alias("reference_ok"))


@query(duck_ctes("claims") + " SELECT claim_id, merchant_id, order_id, amount_minor, currency, sender_name, receiver_name, reference_id, occurred_s, proof_sha256 FROM claims")
def persisted_claims(spark, sf):
    return tables.persisted_claims(views(spark, sf)["claims"])


# ---- near images, coverage, proofs in versions

IMAGES = """WITH i AS (SELECT vec_id, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[(i + 1) % 64 + 1] > embedding[i + 1] THEN 1::HUGEINT << i::HUGEINT ELSE 0::HUGEINT END))::UBIGINT AS h FROM embeddings),
g AS (SELECT h, min(vec_id) AS id FROM i GROUP BY h)
"""


@query(IMAGES + "SELECT a.id AS image_a, b.id AS image_b, CAST(bit_count(xor(a.h, b.h)) AS INT) AS distance FROM g a JOIN g b ON a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= 12")
def near_images(spark, sf):
    """Vectors read as rows of grey values: all pairs whose difference hashes are at most 12 bits apart."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", images.difference_hash(F.col("embedding")).alias("h"))
    return images.near_classes(v, "vec_id", "h", 12, share=3).withColumnsRenamed({"class_a": "image_a", "class_b": "image_b"})


@query(
    DECIDE
    + """, mentions AS (SELECT claim_id, fired AS rule, status, unnest(list_distinct(list_filter([
    CASE WHEN con THEN 'FIELD_CONTRADICTS_MATCH' END, CASE WHEN fired = 'R080' THEN 'AMOUNT_OVERPAID' END,
    CASE fired WHEN 'R010' THEN 'NO_CANDIDATES' WHEN 'R020' THEN 'TXN_ALREADY_ALLOCATED' WHEN 'R025' THEN 'PROOF_REUSED' WHEN 'R030' THEN 'CLAIM_INFLATED' WHEN 'R040' THEN 'TAMPER_OBSERVATIONS' WHEN 'R050' THEN 'AMBIGUOUS_CANDIDATES'
        WHEN 'R060' THEN 'NAME_MISMATCH' WHEN 'R065' THEN 'SOURCE_PARTIALLY_TRUSTED' WHEN 'R067' THEN 'LOW_EXTRACTION_CONFIDENCE' WHEN 'R070' THEN 'AMOUNT_UNDERPAID' WHEN 'R072' THEN 'AMOUNT_OVERPAID_MATERIAL' WHEN 'R075' THEN 'FIELD_CONTRADICTS_MATCH'
        WHEN 'R080' THEN 'STRONG_FIELD_AGREEMENT' WHEN 'R090' THEN 'STRONG_FIELD_AGREEMENT' END,
    CASE WHEN cmp THEN CASE WHEN em IS NULL THEN 'MISSING_ORDER_AMOUNT' WHEN em = ta THEN 'AMOUNT_EXACT' WHEN em > ta THEN 'AMOUNT_UNDERPAID' ELSE 'AMOUNT_OVERPAID' END END, CASE WHEN mo THEN 'AMOUNT_OVERPAID_MATERIAL' END,
    CASE WHEN cmp AND cam IS NOT NULL THEN CASE WHEN cam = ta THEN 'CLAIM_CONSISTENT' WHEN cam > ta THEN 'CLAIM_INFLATED' ELSE 'CLAIM_DEFLATED' END END], lambda r: r IS NOT NULL))) AS reason FROM v),
got AS (SELECT 'rule' AS level, fired AS rule, status, NULL AS reason, count(*) AS claims FROM v GROUP BY ALL UNION ALL SELECT 'status', NULL, status, NULL, count(*) FROM v GROUP BY ALL
    UNION ALL SELECT 'reason', NULL, NULL, reason, count(*) FROM mentions GROUP BY ALL UNION ALL SELECT 'total', NULL, NULL, NULL, count(*) FROM v),
want AS (SELECT 'rule' AS level, r AS rule, CASE WHEN r IN ('R010', 'R060') THEN 'UNMATCHED' WHEN r IN ('R020', 'R025') THEN 'DUPLICATE' WHEN r IN ('R030', 'R040') THEN 'SUSPICIOUS' WHEN r IN ('R080', 'R090') THEN 'VERIFIED' ELSE 'NEEDS_REVIEW' END AS status, NULL AS reason
        FROM unnest(['R010', 'R020', 'R025', 'R030', 'R040', 'R050', 'R060', 'R065', 'R067', 'R070', 'R072', 'R075', 'R080', 'R090', 'R999']) AS u(r)
    UNION ALL SELECT 'status', NULL, s, NULL FROM unnest(['SUSPICIOUS', 'DUPLICATE', 'NEEDS_REVIEW', 'UNMATCHED', 'VERIFIED']) AS u(s)
    UNION ALL SELECT 'reason', NULL, NULL, x FROM unnest(['NO_CANDIDATES', 'TXN_ALREADY_ALLOCATED', 'PROOF_REUSED', 'CLAIM_INFLATED', 'TAMPER_OBSERVATIONS', 'AMBIGUOUS_CANDIDATES', 'NAME_MISMATCH', 'SOURCE_PARTIALLY_TRUSTED', 'LOW_EXTRACTION_CONFIDENCE',
        'AMOUNT_UNDERPAID', 'AMOUNT_OVERPAID_MATERIAL', 'FIELD_CONTRADICTS_MATCH', 'AMOUNT_OVERPAID', 'STRONG_FIELD_AGREEMENT', 'AMOUNT_EXACT', 'MISSING_ORDER_AMOUNT', 'CLAIM_CONSISTENT', 'CLAIM_DEFLATED']) AS u(x)
    UNION ALL SELECT 'total', NULL, NULL, NULL)
SELECT coalesce(g.level, w.level) AS level, coalesce(g.rule, w.rule) AS rule, coalesce(g.status, w.status) AS status, coalesce(g.reason, w.reason) AS reason, coalesce(g.claims, 0) AS claims, w.level IS NOT NULL AS expected
FROM got g FULL JOIN want w ON g.level = w.level AND g.rule IS NOT DISTINCT FROM w.rule AND g.status IS NOT DISTINCT FROM w.status AND g.reason IS NOT DISTINCT FROM w.reason"""
)
def rule_coverage(spark, sf):
    """Decisions without names by rule, status and reason, with those that no claim got."""
    return reports.coverage(decided_core(spark, sf))


@query(
    duck_ctes("submissions")
    + """, s AS (SELECT *, row_number() OVER (PARTITION BY merchant_id, sha256 ORDER BY doc_id % 2, submitted_s, 'V' || CAST(doc_id AS VARCHAR)) AS i FROM submissions WHERE sha256 IS NOT NULL AND doc_id % 5 <> 4)
SELECT merchant_id, sha256, order_id, 'V' || CAST(doc_id AS VARCHAR) AS verification_id FROM s WHERE i = 1"""
)
def proof_memory(spark, sf):
    """All submissions wait, in two batches; four of five are approved, those of even documents first. The accepted proofs."""
    s = views(spark, sf)["submissions"].withColumn("verification_id", F.concat(F.lit("V"), F.col("doc_id"))).withColumn("order_ref", F.lit(None).cast("string"))
    store = snapshots.Snapshots(spark, new_path(spark, "proofs"))
    for odd in (0, 1):
        batch = s.where(F.col("doc_id") % 2 == odd)
        workflow.record_pending(store, batch)
        workflow.approve_pending(store, batch.where("doc_id % 5 <> 4"))
    return store.read("accepted", workflow.PROOF).select("merchant_id", "sha256", "order_id", "verification_id")


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT user_id, ts FROM events WHERE ts IS NOT NULL), p AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id "
    "UNION ALL SELECT p.user_id, min(e.ts) FROM p JOIN e ON e.user_id IS NOT DISTINCT FROM p.user_id AND e.ts >= p.ts + INTERVAL 6 HOURS GROUP BY p.user_id, p.ts) SELECT user_id, ts FROM p"
)
def requests_let_through(spark, sf):
    """All events as requests of their users, whose keys live for six hours."""
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.lit("M").alias("merchant_id"), F.col("user_id").alias("key"), "ts")
    return streaming.unique_requests(e, "6 hours").select(F.col("key").alias("user_id"), "ts")


@query(
    "WITH b AS (SELECT CAST(text AS BLOB) AS content, 1 AS d, 0 AS p FROM (SELECT encode(text) AS text FROM documents WHERE text IS NOT NULL) UNION ALL SELECT encode(html), 0, 1 FROM pages WHERE html IS NOT NULL) "
    "SELECT sha256(content) AS sha256, any_value(octet_length(content)) AS bytes, sum(d)::BIGINT AS documents, sum(p)::BIGINT AS pages, any_value(sha256(content)) AS read_back FROM b GROUP BY 1"
)
def stored_contents(spark, sf):
    """Texts and pages as contents by digest, the texts put twice: each once, with the rows that name it and the digest of what is read back."""
    d, p = spark.read.parquet(f"{sf}/documents.parquet").select("text"), spark.read.parquet(f"{sf}/pages.parquet").select("html")
    store = snapshots.Snapshots(spark, new_path(spark, "contents"))
    for rows, column in ((d, "text"), (p, "html"), (d, "text")):
        blobs.put(store, rows, column)
    named = d.select(F.sha2("text", 256).alias("k"), F.lit(1).alias("d"), F.lit(0).alias("p")).unionByName(p.select(F.sha2("html", 256).alias("k"), F.lit(0).alias("d"), F.lit(1).alias("p")))
    counts = named.where("k is not null").groupBy("k").agg(F.sum("d").alias("documents"), F.sum("p").alias("pages"))
    return blobs.get(store, counts, "k").select(F.col("k").alias("sha256"), "bytes", "documents", "pages", F.sha2("content", 256).alias("read_back"))
