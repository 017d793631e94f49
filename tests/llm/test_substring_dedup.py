from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows as plain

from ledgerloom.llm import substring_dedup as S

SCHEMA = "doc_id long, text string"


def brute(rows, window):
    """Every window against the first place of its words."""
    texts = [(i is None, i or 0, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for nil, doc, w in texts:
        for k in range(len(w) - window + 1):
            p, at = tuple(w[k : k + window]), (nil, doc, k)
            first[p] = min(first.get(p, at), at)
    out = []
    for nil, doc, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] != (nil, doc, k):
                gone.update(range(k, k + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((None if nil else doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(frame):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in frame.collect()), key=repr)


def made(seed, n, window):
    """Prose with copies, shared passages in new surroundings, loops, passages that overlap, and odd words."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["é", "Stop", "stop", "stop.", "a", "b c"]) if rng.random() < 0.1 else f"w{rng.randrange(10**6)}"
    shared = [[word() for _ in range(rng.randrange(window - 2, 4 * window))] for _ in range(6)]
    out = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(4)):
            w += [word() for _ in range(rng.randrange(3 * window))]
            x = rng.choice(shared)
            a = rng.randrange(len(x))
            w += rng.choice([x, x, x[a:], x[:a], ["loop", "de"] * a, ["x"] * rng.randrange(3 * window)])
        out.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    out += [(100 + i, rng.choice(out)[1]) for i in range(n // 3)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("window", "hot", "shard"), [(20, 4096, 300_000), (20, 2, 50), (12, 0, 1), (5, 3, 200), (9, 1, 40)])
def test_against_brute_force(spark, window, hot, shard):
    rows = [*made(window + hot, 60, window), (None, None), (-3, made(1, 1, window)[0][1]), (200, None), (201, ""), (202, " \n"), (203, "one two")]
    rows += [(None, rows[0][1]), (None, rows[1][1]), rows[2], rows[2], (rows[3][0], "other " + rows[3][1]), (rows[3][0], rows[4][1])]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 AS mark", "2 AS place", "'x' AS words")
    got = S.drop_repeats(frame, window, hot, shard)
    assert result(got) == brute(rows, window)
    for r in got.collect():
        assert sum(x["words"] for x in r["spans"]) == r["n_removed"] and len(re.findall(r"[^\x20\x09-\x0D]+", r["kept"])) == r["n_words"] - r["n_removed"]


def test_common_line_and_many_copies(spark):
    """One passage in most documents, in surroundings of their own, and one text in hundreds of copies."""
    rng = random.Random(3)
    line = [f"l{i}" for i in range(30)]
    rows = [(i, " ".join([f"u{rng.randrange(10**6)}" for _ in range(25)] + line + [f"v{rng.randrange(10**6)}" for _ in range(25)])) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(400)]
    assert result(S.drop_repeats(spark.createDataFrame(rows, SCHEMA).repartition(7), hot=20, shard_words=500)) == brute(rows, 20)


def test_long_and_empty(spark):
    rows = [(1, "long " * 60_000), (2, " ".join(f"n{i}" for i in range(40_000))), (3, " ".join(f"n{i}" for i in range(100, 200)))]
    assert [r[2] for r in result(S.drop_repeats(spark.createDataFrame(rows, SCHEMA)))] == [60_000 - 1, 0, 100]  # the window at word 1 repeats that at word 0
    assert S.drop_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_sift_batches(batch):
    """What goes and what is compared, however the sorted rows are cut into batches."""
    rng = random.Random(batch)
    rows = sorted((rng.randrange(40), rng.randrange(2), False, rng.randrange(6), 0, rng.randrange(3) * S.PLACES + 1) for _ in range(300))
    rows = [(a, d, n, x, m, p) for a, d, n, x, m, p in rows]
    names = ["anchor", "digest", *S.KEY, "place"]
    table = pa.Table.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names).append_column("sure", pa.array([False] * len(rows)))
    got = [tuple(r[x] for x in ("open", "anchor", "doc_id", "place")) for b in S._sift(iter(table.to_batches(max_chunksize=batch))) for r in b.to_pylist()]
    want, ends = [], (rows[0][0], rows[-1][0])
    for a, d, _, x, _, p in rows:
        least = min(r[3:] for r in rows if r[:2] == (a, d))
        if (x, 0, p) != least:
            want.append((False, a, x, p))
        elif len({r[1] for r in rows if r[0] == a}) > 1 or a in ends:
            want.append((True, a, x, p))
    assert sorted(set(got)) == sorted(set(want)) and sum(not r[0] for r in got) == sum(not r[0] for r in want)


def test_stretches_are_of_content():
    words = [f"w{i}" for i in range(200)]
    one, two = S.stretches([" ".join(words[50:150])]), S.stretches(["x y z", " ".join(words)])
    inner = {(int(a), int(d)) for a, d in zip(*one[2:], strict=True)}
    outer = {(int(a), int(d)) for a, d in zip(*two[2:], strict=True)}
    assert len(inner - outer) <= 2 and (one[1] % S.PLACES).sum() == 81 and (two[0] == 1).all()
    v = np.asarray([5, 3, 3, 9, 1, 1, 7], np.uint64)
    assert S.least_of(v, 3).tolist() == [1, 1, 4, 4, 4] and S.least_of(v, 1).tolist() == list(range(7))


def test_query_equals_sql(spark, sf, duck):
    got, want = S.op12_substring_dedup(spark, sf).toPandas(), duck.sql(S.OP12_SQL).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want) and got["n_removed"].sum() > 0
