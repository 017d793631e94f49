from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from ledgerloom.llm import near_dup as N
from ledgerloom.llm.components import connected
from ledgerloom.llm.shingles import shingle_sets


def shingles(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    common = collections.Counter((a, b) for l in where.values() for a in l for b in l if a < b)
    for (a, b), k in common.items():
        if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = N.op4_near_duplicates(spark, sf).collect()
    want = brute(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize(("block", "rounds", "heavy"), [(512, 3, 100_000), (4, 1, 3), (4, 0, 100_000)])
def test_group_of_siblings(spark, monkeypatch, block, rounds, heavy):
    """Siblings of one text, near the threshold: linked ones and single ones, as brute force has them."""
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "ROUNDS", rounds)
    monkeypatch.setattr(N, "ROUND_COST", block)
    monkeypatch.setattr(N, "HEAVY", heavy)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 6])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100, rows[0][1]), (101, rows[0][1].upper().replace("W", "w")), (102, "\t".join(rows[3][1].split()))]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (None, "one two"), (7, "long " * 50_000), (8, "one two"), (8, "one two"), (9, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'c' AS component_id", "2 AS key")
    got = N.near_duplicates(df).collect()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert len(got) == len(rows) and by[1] == (0, 1, True) and by[4] == (1, 4, True) and by[5] == (1, 4, False) and by[8] == (1, 4, False) and by[6] == (1, 6, True)
    assert by[7][0] == 1 and by[None] == (1, None, True)
    left = N.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 6, 7, 9]
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_sketch_estimates_and_merging():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    both = np.unique(np.concatenate([a, b]))
    r = N.sketches(np.concatenate([a, b, both]), np.asarray([0, 2000, 4000, 4000 + len(both)]))
    assert (np.maximum(r[0], r[1]) == r[2]).all()
    est = N.estimate(r[:1], r[1:2], np.asarray([2000.0]), np.asarray([2000.0]))[0]
    assert abs(est - 1500 / 2500) < 0.15
    assert (N.sketches(np.zeros(0, np.uint64), np.asarray([0, 0])) == 0).all()
    h, ends = shingle_sets(["a b c d e f", "A B c d e f", "a", ""])
    assert (h[: ends[1]] == h[ends[1] : ends[2]]).all() and np.diff(ends).tolist() == [2, 2, 1, 0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    got = {r["id"]: r["component"] for r in connected(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[100], got[101], got[102]} == {100} and 200 not in got
    assert connected(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_tiny_sets_share_a_band():
    """3 of 4 shingles shared, 40,000 pairs: 1e-2 pairs without a common band are expected."""
    rng = np.random.default_rng(1)
    for _ in range(4):
        pool = rng.integers(0, 2**64, (10_000, 4), dtype=np.uint64)
        a, b = (N.sketches(x.ravel(), np.arange(0, x.size + 1, x.shape[1])) for x in (np.sort(pool[:, :3], 1), np.sort(pool, 1)))
        same = (a.reshape(-1, N.BANDS, N.ROWS) == b.reshape(-1, N.BANDS, N.ROWS)).all(2).any(1)
        assert same.all()
