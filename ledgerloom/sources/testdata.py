"""Payment tables derived from orders and documents: whole-number arithmetic only, nothing random.

One SQL text serves Spark and DuckDB; {epoch}, {idiv} and the like stand for
what the two spell differently. Every rule of the decision table fires on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = "ayesha,bilal,zulqarnain,fatima,hamza,muhammad,sana,usman,nadia,tariq,rabia,faisal"
LAST = "khan,qureshi,ali,siddiqui,chaudhry,hussain,malik,sheikh,ahmad,raza,iqbal,javed"

LEDGER = """
SELECT {k9} AS txn_id, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE {ext} END AS external_id,
    {minor} AS amount_minor, 'PKR' AS currency, {at} AS occurred_s,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE {merchant} END AS merchant_id,
    {sender} AS sender_name, 'corner store ' || split_part('" + LAST + "', ',', CAST(o_custkey % 12 AS INT) + 1) AS receiver_name,
    CASE WHEN o_orderkey % 40 = 6 THEN 'CUSTOMER_SCREENSHOT' WHEN o_orderkey % 10 = 7 THEN 'MERCHANT_CSV' WHEN o_orderkey % 10 = 8 THEN 'MANUAL_ENTRY'
        WHEN o_orderkey % 10 = 9 THEN 'PROVIDER_API' WHEN o_orderkey % 20 = 5 THEN 'MERCHANT_CSV' ELSE 'MERCHANT_LEDGER' END AS source,
    CASE WHEN o_orderkey % 23 = 0 THEN 'REVERSED' WHEN o_orderkey % 23 = 1 THEN 'PENDING' ELSE 'POSTED' END AS status
FROM orders WHERE o_orderkey % 13 <> 0
UNION ALL
SELECT 'TW' || lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0'), NULL, {minor}, 'PKR', {at}, {merchant}, {sender}, 'twin store', 'MERCHANT_LEDGER', 'POSTED'
FROM orders WHERE o_orderkey % 11 = 3
""".replace('" + LAST + "', LAST)

CLAIMS = """
SELECT 'CL' || lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0') AS claim_id, CASE WHEN o_orderkey % 95 = 0 THEN 'M-NEW' ELSE {merchant} END AS merchant_id, {order_id} AS order_id,
    CASE {p} WHEN 4 THEN {minor} * 10 WHEN 5 THEN {minor} + 1 WHEN 11 THEN NULL ELSE {minor} END AS amount_minor, 'PKR' AS currency,
    CASE {p} WHEN 8 THEN replace({sender}, 'a', 'e') WHEN 9 THEN substr({sender}, 1, 3) || '*** ' || split_part({sender}, ' ', 2) WHEN 10 THEN 'muhammad ali' ELSE {sender} END AS sender_name,
    CAST(NULL AS VARCHAR(40)) AS receiver_name,
    CASE WHEN {p} = 1 THEN replace({ext}, '0', 'O') WHEN {p} = 2 THEN right({ext}, 6) WHEN {p} IN (3, 10) THEN NULL WHEN o_orderkey % 11 = 3 THEN NULL ELSE 'TID: ' || {ext} END AS reference_id,
    CASE WHEN {p} = 6 THEN {at} + 3600 WHEN {p} = 7 THEN {day} WHEN {p} = 10 THEN {at} + 400000 ELSE {at} + 30 END AS occurred_s,
    CASE WHEN {p} = 7 THEN 86400 ELSE 60 END AS granularity_s, false AS tz_stated, {p} = 7 AS date_inferred,
    {sha}('proof-' || CAST(o_orderkey % 1999 AS VARCHAR(20)){shatail}) AS proof_sha256, o_orderkey AS n, {at} AS now_s
FROM orders WHERE o_orderkey % 5 = 0
"""

ORDERS = """
SELECT {order_id} AS order_id, {merchant} AS merchant_id, 'PKR' AS currency,
    CASE o_orderkey % 7 WHEN 0 THEN {minor} * 2 WHEN 1 THEN {minor} - 500 WHEN 2 THEN NULL WHEN 3 THEN {half} - 1 ELSE {minor} END AS expected_minor
FROM orders WHERE o_orderkey % 5 = 0
"""

ALLOCATIONS = """
SELECT {k9} AS txn_id, CASE WHEN o_orderkey % 2 = 0 THEN {order_id} ELSE 'ORDX' || CAST(o_orderkey AS VARCHAR(20)) END AS order_id,
    'V' || CAST(o_orderkey AS VARCHAR(20)) AS verification_id, {at} + 60 AS allocated_s, CASE WHEN o_orderkey % 51 = 0 THEN 'RELEASED' ELSE 'ACTIVE' END AS status
FROM orders WHERE o_orderkey % 17 = 0
UNION ALL
SELECT {k9}, 'ORDY' || CAST(o_orderkey AS VARCHAR(20)), NULL, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE {at} + 30 END, 'ACTIVE' FROM orders WHERE o_orderkey % 68 = 0
"""

PROOFS = """
SELECT DISTINCT {sha}('proof-' || CAST(o_orderkey % 1999 AS VARCHAR(20)){shatail}) AS sha256, 'ORDZ' || CAST(o_orderkey % 1999 AS VARCHAR(20)) AS order_id,
    CASE WHEN o_orderkey % 1999 % 2 = 0 THEN 'SHOP-' || CAST(o_orderkey % 1999 AS VARCHAR(20)) ELSE NULL END AS order_ref, 'VZ' AS verification_id, o_orderkey % 1999 AS submitted_s
FROM orders WHERE o_orderkey % 1999 < 40
"""

SUBMISSIONS = """
SELECT doc_id, {sha}({enc}) AS sha256, 'ORD' || CAST(doc_id AS VARCHAR(20)) AS order_id, doc_id AS submitted_s, 'M' || CAST(doc_id % 8 AS VARCHAR(20)) AS merchant_id FROM documents
"""

NAMES = {"ledger": LEDGER, "claims": CLAIMS, "expected": ORDERS, "allocations": ALLOCATIONS, "proofs": PROOFS, "submissions": SUBMISSIONS}


def render(sql: str, duck: bool) -> str:
    div = (lambda a, b: f"({a} // {b})") if duck else (lambda a, b: f"({a} div {b})")
    k = "CAST(o_orderkey AS VARCHAR(20))"
    cast = "CAST(round({x}) AS BIGINT)"
    day = "CAST(epoch(o_orderdate) AS BIGINT)" if duck else "unix_timestamp(o_orderdate)"
    words = {
        "k9": f"'TX' || lpad({k}, 9, '0')",
        "ext": f"CASE o_orderkey % 3 WHEN 0 THEN 'EP' WHEN 1 THEN 'JC' ELSE 'RA' END || lpad({k}, 8, '0')",
        "minor": cast.format(x="o_totalprice * 100"),
        "half": div(cast.format(x="o_totalprice * 100"), 2),
        "day": day,
        "at": f"({day} + (o_orderkey * 7919) % 86400)",
        "merchant": "'M' || CAST(o_custkey % 16 AS VARCHAR(20))",
        "sender": f"split_part('{FIRST}', ',', CAST(o_custkey % 12 AS INT) + 1) || ' ' || split_part('{LAST}', ',', CAST({div('o_custkey', 12)} % 12 AS INT) + 1)",
        "order_id": f"'ORD' || lpad({k}, 8, '0')",
        "p": f"(({div('o_orderkey', 5)}) % 12)",
        "sha": "sha256" if duck else "sha2",
        "shatail": "" if duck else ", 256",
        "enc": "text" if duck else "text, 256",
    }
    for _ in range(2):
        for name, value in words.items():
            sql = sql.replace("{" + name + "}", value)
    return sql


def duck_ctes(*names: str) -> str:
    """WITH clauses for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({render(NAMES[n], True)})" for n in names)


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """ledger, claims, expected, allocations, proofs, submissions; claims also have notes, observations and confidences."""
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").createOrReplaceTempView("documents")
    out = {n: spark.sql(render(sql, False)) for n, sql in NAMES.items()}
    n = F.col("n")
    out["claims"] = out["claims"].withColumns({
        "notes": F.when(n % 30 == 5, F.array(F.lit("degraded:ocr"))).otherwise(F.array().cast("array<string>")),
        "observations": F.when(n % 35 == 10, F.array(F.lit("IMAGE_EDITOR_SIGNATURE"), F.lit("IMAGE_RECOMPRESSED"))).otherwise(F.array().cast("array<string>")),
        "confidences": F.create_map(F.lit("amount"), F.when(n % 45 == 0, F.lit(0.5)).otherwise(F.lit(1.0)), F.lit("reference_id"), F.lit(1.0)),
    })
    return out
