from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import rows as plain

from ledgerloom.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(family, [])[:h] + turns[h:]
    return out


def brute(sequences):
    """Nodes as whole prefixes."""
    members, kids = collections.defaultdict(list), collections.defaultdict(set)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    out = []
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(sequences[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), parent, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(frame):
    assert frame.columns == T.NODE
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def made(seed, convs, length, few=3):
    rng = random.Random(seed)
    texts = [*("abcdé"[:few]), None, "", "long 𝄞 text"]
    out = []
    for c in range(convs):
        c = c * rng.choice([1, 1, 1, -1, 13])
        for t in range(rng.randrange(length)):
            out.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None, "", "assistant"]), rng.choice(texts[: rng.choice([1, 2, 6])])))
    return out


@pytest.mark.parametrize(("shard", "per_task"), [(10**6, 10**6), (5, 40), (1, 17), (60, 10**6)])
def test_shards_of_any_size(spark, shard, per_task):
    """Copies, shared beginnings, conversations that begin others, turnless ones: as brute force has them, however the shards fall."""
    rows = made(1, 400, 9) + [(500 + i, t, "user", "hot") for i in range(150) for t in range(3)] + [(None, 1, "user", "x")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 AS path", "2 AS family", "'k' AS key")
    conv = T.F.col("conv_id")
    sequences = T.prefix_sequences(frame, conv - conv % 100, T.F.crc32(conv.cast("string")) % 6, 5)
    assert result(T.trie(sequences, shard, per_task)) == brute(rebuilt(rows))


def test_long_conversations(spark):
    """Each longer than a shard: levels still get smaller."""
    rows = [(c, t, "user", "s" if t < 40 + c else f"{c}") for c in range(40) for t in range(120)]
    got = result(T.trie(T.prefix_sequences(spark.createDataFrame(rows, SCHEMA)), 10, 100))
    assert got == brute({c: [("user", "s" if t < 40 + c else f"{c}") for t in range(120)] for c in range(40)})


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert result(T.trie(T.prefix_sequences(empty))) == []
    one = spark.createDataFrame([(7, None, None, None), (7, None, None, None)], SCHEMA)
    assert result(T.trie(T.prefix_sequences(one))) == brute({7: [("", ""), ("", "")]})
    turnless = spark.createDataFrame([(1, b"", b""), (2, b"", b"")], "conv_id long, path binary, lengths binary")
    assert result(T.trie(turnless)) == brute({1: [], 2: []})
    # Roles and texts aren't run together; digests may end in zeros.
    split = spark.createDataFrame([(1, 0, "a", "bc"), (2, 0, "ab", "c")], SCHEMA)
    assert len(result(T.trie(T.prefix_sequences(split)))) == 3


def test_louds():
    words = [[], [1], [1, 2], [1, 2, 3], [1, 4], [5], [5]]
    counts = np.asarray([len(w) for w in words])
    flat = np.asarray([x for w in words for x in w], "<u8")
    trie, node, ends = T.louds(flat, np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    assert trie.bits.tolist() == [1, 1, 0, 1, 1, 0, 0, 1, 0, 0, 0]
    assert trie.labels.tolist() == [0, 1, 5, 2, 4, 3] and trie.parents().tolist() == [-1, 0, 0, 1, 1, 3] and trie.degrees().tolist() == [2, 2, 0, 1, 0, 0]
    assert node.tolist() == [1, 1, 3, 1, 3, 5, 1, 4, 2, 2] and ends.tolist() == [0, 1, 3, 5, 4, 2, 2]


def test_query_equals_sql(spark, sf, duck):
    got, want = T.op11_prefix_trie(spark, sf).toPandas(), duck.sql(T.OP11_SQL).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(T.op11_prefix_trie(spark, sf)) == brute(rebuilt(rows))
