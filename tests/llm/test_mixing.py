from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing as M


def brute_targets(sizes: dict, weights=M.WEIGHTS, share=M.SHARE, cap=M.CAP):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > cap * sizes[s] + 1e-9}
        if not over:
            return out | {s: w[s] * level for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_query(spark, sf):
    d = M.op2_mix(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert dict(zip(d.doc_id, d["size"], strict=True)) == words and len(d) == len(docs)
    assert ((d.taken == 0) | (d.taken == d["size"]) | (d.taken == 2 * d["size"])).all()
    by = d.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), said=("source_size", "first"))
    want = brute_targets(by["size"].to_dict())
    assert (by["size"] == by.said).all()
    for s, r in by.iterrows():
        assert r.target == pytest.approx(want[s]) and abs(r.taken - r.target) <= max(0.02 * r.target, 40)
    again = M.op2_mix(spark, sf).toPandas()
    assert sorted(zip(d.doc_id, d.taken, strict=True)) == sorted(zip(again.doc_id, again.taken, strict=True))


def test_odd_rows(spark):
    data = [(1, "a b c", None, "x"), (1, "a b c", None, "x"), (None, None, "s", None), (2, "", "s", None), (3, "w " * 50_000, "t", None)] + [(10 + i, "x y", "u", None) for i in range(30)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, n string").withColumn("size", F.lit("clash"))
    out = M.mix(docs)
    assert out.columns == docs.columns
    assert {r["source"] for r in out.collect()} >= {None, "t", "u"}
    counts = {r[0]: r[1] for r in out.groupBy("doc_id").count().collect()}
    assert all(v <= 4 if k == 1 else v <= 2 for k, v in counts.items() if k is not None)
    assert M.mix(docs.limit(0)).count() == 0


def brute_multiplier(sizes, target, cap=M.CAP):
    """Bisection on sum(size min(cap, exp(lam size))) = target over single documents."""
    lo, hi = -50.0, 50.0
    for _ in range(300):
        mid = (lo + hi) / 2
        taken = sum(x * min(cap, math.exp(min(700.0, mid * x))) for x in sizes)
        lo, hi = (mid, hi) if taken < target else (lo, mid)
    return (lo + hi) / 2


def test_rates_are_the_optimum_of_single_documents(spark, sf):
    """Every document's own rate equals that of a brute-force optimiser, and no multiplier is the logarithm of target by size."""
    d = M.op2_mix(spark, sf).toPandas()
    below = 0
    for s in d.source.unique():
        own = d[d.source == s] if s is not None else d[d.source.isna()]
        size, target = own.source_size.iloc[0], own.target.iloc[0]
        if target >= M.CAP * size * (1 - 1e-9):
            assert (own.rate[own["size"] > 0] > M.CAP - 1e-6).all()
            continue
        lam = brute_multiplier(own["size"].tolist(), target)
        want = [min(M.CAP, math.exp(lam * x)) for x in own["size"]]
        assert own.rate.tolist() == pytest.approx(want, rel=1e-5, abs=1e-7)
        assert own.rate.nunique() == own["size"][own.rate < M.CAP].nunique() + bool((own.rate >= M.CAP).any()) and abs(lam - math.log(target / size)) > 1e-4
        below += 1
    assert below


def test_prior_rates_reach_their_targets(spark):
    rows = [("a", 1.0, 100, 1), ("a", 0.2, 30, 10), ("b", 1.0, 5, 10), ("c", 1.0, 10, 1), (None, 1.0, 7, 4)]
    classes = spark.createDataFrame(rows, "source string, q double, size long, n long")
    targets = spark.createDataFrame([("a", 120.0, 400, 11), ("b", 97.9, 50, 10), ("c", 0.0, 10, 1), (None, 9.0, 28, 4)], "source string, target double, source_size long, n long")
    lam = {r["of"]: r["lam"] for r in M.solve_rates(classes, targets).collect()}
    for s, want in (("a", 120.0), ("b", 97.9), (None, 9.0)):
        assert sum(n * x * min(M.CAP, q * math.exp(lam[s] * x)) for t, q, x, n in rows if t == s) == pytest.approx(want)


def test_many_sources_are_salted(spark, monkeypatch):
    data = [(i, " ".join(["w"] * (1 + i % 50)), f"s{i % 7}") for i in range(2000)]
    rows = spark.createDataFrame(data, "id long, text string, source string").select("id", M.count_words(F.col("text")).alias("size"), "source", F.lit(0).alias("mark"))
    plain = sorted((r["id"], r["total"]) for r in M.copies(rows).collect())
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    assert sorted((r["id"], r["total"]) for r in M.copies(rows).collect()) == plain


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 7, 8, "x")], "doc_id long, text string, source string, size int, __size int, mark string")
    assert {tuple(r) for r in M.mix(docs).collect()} <= {(1, "a b", "s", 7, 8, "x")} and M.mix(docs).columns == docs.columns
