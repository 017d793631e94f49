from __future__ import annotations

import hashlib
import random
import re

from ledgerloom.llm import fingerprints as P


def sets(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rows):
    out = {}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out[i] = t[: len(t) - half] + nxt[:half]
    return out


def test_query(spark, sf):
    rows = sorted(((r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()), key=lambda r: -r[0])
    want, text = edited(rows), dict(rows)
    nxt = {r[0]: rows[(k + 1) % len(rows)][1] for k, r in enumerate(rows)}
    got = P.op5_fingerprints(spark, sf).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        i = r["doc_id"]
        assert r["n_chars"] == len(text[i]) and r["edited_sha256"] == hashlib.sha256(want[i].encode()).hexdigest()
        assert abs(r["near_edited"] - jaccard(sets(text[i]), sets(want[i]))) < 0.16 and abs(r["near_next"] - jaccard(sets(text[i]), sets(nxt[i]))) < 0.16
        assert by_text.setdefault(text[i], r["fingerprint"]) == r["fingerprint"]


def test_odd_rows(spark):
    rows = [(5, "a b c d e f 😀 g"), (4, None), (3, ""), (2, "one"), (1, "word " * 20_000), (2, "one"), (None, "last text of all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS id", "'c' AS prev", "'c' AS fp")
    got = P.fingerprint_documents(df).collect()
    ring = [(5, rows[0][1]), (4, ""), (3, ""), (2, "one"), (1, rows[4][1]), (None, rows[6][1])]
    want = edited(ring)
    assert len(got) == len(rows)
    for r in got:
        assert r["edited_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()
    by = {r["doc_id"]: r for r in got}
    assert by[4]["fingerprint"] == "" and by[4]["near_next"] == 1.0 and by[3]["near_next"] == 0.0
    assert P.fingerprint_documents(df.limit(0)).count() == 0
    one = P.fingerprint_documents(df.limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def shuffled(spark, work):
    """MB that work() writes to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    jvm = spark.sparkContext._jvm
    empty = jvm.java.util.ArrayList

    def stages():
        found = spark.sparkContext._jsc.sc().statusStore().stageList(empty(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), empty())
        found = [found.apply(i) for i in range(found.size())]
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in found}

    before = stages()
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before) / 1e6


def test_texts_are_shuffled_once(spark, tmp_path):
    """One shuffle of the texts and one of their halves: 1.5 times the texts, not 2.5. Large tables' ids are not broadcast."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.randbytes(8).hex() for _ in range(400))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    text = spark.read.parquet(f"{tmp_path}/documents.parquet").select("text")
    once = shuffled(spark, lambda: text.repartition(4).foreach(lambda r: None))
    limits = {x: spark.conf.get(x, None) for x in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for x in limits:
        spark.conf.set(x, "-1")
    try:
        got = shuffled(spark, lambda: P.op5_fingerprints(spark, str(tmp_path)).collect())
    finally:
        for x, value in limits.items():
            spark.conf.set(x, value) if value is not None else spark.conf.unset(x)
    assert once > 1 and got < 1.9 * once


def test_null_and_least_id(spark):
    """A null doc_id is a document of its own, after the least long."""
    rows = [(7, "first text of all here"), (-(2**63), "the least long there is"), (None, "no id whatsoever, comes last")]
    got = {r["doc_id"]: r for r in P.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = edited(rows)
    assert set(got) == set(want) and all(got[i]["edited_sha256"] == hashlib.sha256(want[i].encode()).hexdigest() for i in want)
