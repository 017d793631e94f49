"""Queries against their SQL, and language ID against exact sets of n-grams; held-out quality of toxicity."""

from __future__ import annotations

import collections

import pytest
from conftest import rows

from ledgerloom.llm import fingerprints as P
from ledgerloom.llm import language_id as L
from ledgerloom.llm import near_dup as N
from ledgerloom.llm import toxicity as T
from ledgerloom.llm import url_filter as U
from ledgerloom.llm import warc as A


def test_near_duplicates_equal_sql(spark, sf, duck):
    assert rows(N.op4_near_duplicates(spark, sf).toPandas()) == rows(duck.sql(N.OP4_SQL).df())


def test_warc_equals_sql(spark, sf, duck):
    assert rows(A.op8_warc(spark, sf).toPandas()) == rows(duck.sql(A.OP8_SQL).df())


def exact_grams(text):
    flat = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    for n in L.SIZES:
        for i in range(len(flat) - n + 1):
            g = flat[i : i + n]
            if all(c != " " for c in g[1:-1]) and (g[0] != " " or g[-1] != " "):
                yield n, g


def test_language_filters_equal_exact_sets(spark, sf):
    """The same shares and ratios with plain sets in place of the filters: the same language for every document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "n_chars").collect()
    held = {r["doc_id"]: r["held_out"] for r in L.op3_language_id(spark, sf).select("doc_id", "held_out").collect()}
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in {(r["lang"], r["text"]) for r in docs if not held[r["doc_id"]] and r["lang"] and r["text"]}:
        for n, g in exact_grams(text):
            counts[lang, n, g] += 1
            totals[lang, n] += 1
    share = {k: c / totals[k[:2]] for k, c in counts.items() if c / totals[k[:2]] >= L.MIN_SHARE}
    best = collections.defaultdict(float)
    for (_, n, g), x in share.items():
        best[n, g] = max(best[n, g], x)
    members = {lang: {(n, g) for (l, n, g), x in share.items() if l == lang and x >= L.RATIO * best[n, g]} for lang in sorted({k[0] for k in share})}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.op3_language_id(spark, sf).collect()}
    for r in docs:
        grams = list(exact_grams(r["text"] or ""))
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        known = {lang: sum(g in m for g in grams) / len(grams) for lang, m in members.items()}
        lang, score = got[r["doc_id"]]
        assert known[lang] >= max(known.values()) - 0.01 and abs(score - known[lang]) < 0.02


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(labels[r["doc_id"]], r["predicted"]) for r in T.op9_toxicity(spark, sf).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    toxic, clean = [p for t, p in held if t == 1], [p for t, p in held if t == 0]
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.06 * len(clean)


def test_clashing_names(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", "'s' AS score", "'p' AS lang_pred", "1 AS predicted", "2 AS __score", "3 AS gone", "4 AS url")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for out in (L.keep_known(docs), T.drop_toxic(docs, labels), N.drop_near_duplicates(docs)):
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.select("score", "lang_pred", "predicted", "__score", "gone").distinct().collect()} == {("s", "p", 1, 2, 3)}
    rules = spark.createDataFrame(U.RULES, "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.org/x", "q", "z", 5)], "page_id long, url string, rh string, host string, digest int")
    got = U.judge_urls(pages, rules, keep=("page_id", "url", "rh", "digest")).first()
    assert (got["rh"], got["digest"], got["host"], got["rule"]) == ("q", 5, "a.org", "org/")
    with pytest.raises(ValueError):
        U.judge_urls(pages, rules, keep=("page_id", "host"))


def test_least_long_is_not_null(spark):
    docs = spark.createDataFrame([(-(1 << 63), "a b c d e f"), (5, "g h i")], "doc_id long, text string")
    assert {r["doc_id"] for r in P.fingerprint_documents(docs).collect()} == {-(1 << 63), 5}
