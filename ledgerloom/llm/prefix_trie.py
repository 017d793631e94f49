"""Prefix trie of conversations, built in pieces as succinct level-order tries.

A conversation is its turns' 128-bit digests laid end to end, so prefixes of
conversations are prefixes of bytes. Conversations are sorted by these bytes
over the cluster and cut into shards of bounded size, whatever the prefixes: a
shard is a run of neighbours. Each becomes a LOUDS trie in numpy, a bit vector
and an array of labels in level order, and np.add.at from the last level back
to the root rolls its counts up.

Only nodes on the paths to a shard's first and last conversation can go on in
other shards. Those heavy upper levels are merged apart: each shard hands over
its two paths, with what hangs on them already summed up, as if they were
conversations, and the same step builds tries of them until one shard is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Tables, table

#: Bytes of a turn's digest.
WIDTH = 16
#: Turns and conversations of one shard; a task takes about PER_TASK of them, shard by shard.
SHARD, PER_TASK = 200_000, 1_000_000
#: A shard has so many rows at least and hands two on, so every level is smaller than the one before.
LEAST_ROWS = 4
#: Up to so many nodes of the upper levels are broadcast to their children.
BROADCAST_NODES = 500_000
NOBODY = np.iinfo(np.int64).max
#: What a path carries for each node on it: conversations and the least of them, children, leaves and tokens of parts already built.
SUMS = ("convs", "first", "children", "leaves", "saved")
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


@dataclass
class Louds:
    """A trie in level order: bits has 1 for each child and 0 at the end of each node; labels is the last digest of each node."""

    bits: np.ndarray
    labels: np.ndarray
    depth: np.ndarray

    def parents(self) -> np.ndarray:
        """rank0 at each 1: how many nodes ended before it. The root has none (-1)."""
        ones = np.flatnonzero(self.bits)
        return np.concatenate([[-1], (ones - np.arange(len(ones)))])

    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(self.bits == 0), prepend=-1) - 1


def louds(paths: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[Louds, np.ndarray, np.ndarray]:
    """(trie, node of each turn, node of each conversation's end) of sorted conversations.

    paths: all turns' digests end to end; conversation i has counts[i] of them from starts[i].
    """
    n = len(counts)
    owner = np.repeat(np.arange(n), counts)
    depth = np.arange(len(paths)) - np.repeat(starts, counts) + 1
    # A turn is new unless it and all before it are the turns of the conversation before.
    before = np.where((owner > 0) & (depth <= counts[np.maximum(owner - 1, 0)]), starts[np.maximum(owner - 1, 0)] + depth - 1, -1) if len(paths) else np.zeros(0, np.int64)
    same = np.zeros(len(paths), bool)
    at = np.flatnonzero(before >= 0)
    same[at] = paths[at] == paths[before[at]]
    broken = np.cumsum(~same)
    new = broken > np.repeat(np.concatenate([[0], broken])[starts], counts)
    found = np.flatnonzero(new)
    order = found[np.argsort(depth[found], kind="stable")]
    node = np.full(len(paths), -1, np.int64)
    node[order] = np.arange(len(order)) + 1
    # A turn that isn't new is the node that its depth had last: carried forward level by level.
    by_depth = np.lexsort((np.arange(len(paths)), depth))
    carried = np.maximum.accumulate(np.where(node[by_depth] >= 0, np.arange(len(by_depth)), 0)) if len(paths) else by_depth
    node[by_depth] = node[by_depth][carried]
    above = np.where(depth == 1, 0, np.concatenate([[0], node[:-1]]) if len(paths) else node)
    degrees = np.bincount(above[order], minlength=len(order) + 1)
    bits = np.ones(2 * len(order) + 1, np.uint8)
    bits[np.cumsum(degrees) + np.arange(len(degrees))] = 0
    labels = np.concatenate([np.zeros(1, paths.dtype), paths[order]])
    ends = np.zeros(n, np.int64)
    ends[counts > 0] = node[(starts + counts - 1)[counts > 0]]
    return Louds(bits, labels, np.concatenate([[0], depth[order]])), node, ends


class _Shard:
    """Sorted rows, each a path with sums for the nodes on it, as one trie."""

    def __init__(self, paths: list[bytes], lengths: list[bytes], sums: list[bytes]):
        counts = np.asarray([len(x) // WIDTH for x in paths], np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        flat = np.frombuffer(b"".join(paths), f"S{WIDTH}") if counts.any() else np.zeros(0, f"S{WIDTH}")
        self.trie, nodes, self.ends = louds(_whole(flat), starts, counts)
        self.paths, self.counts, n = paths, counts, len(self.trie.depth)
        self.parent, self.degree = self.trie.parents(), self.trie.degrees()
        self.length = np.zeros(n, np.int64)
        self.length[nodes] = np.frombuffer(b"".join(lengths), "<i8")
        # Sums come for the root and each turn of a path.
        at = np.zeros(len(flat) + len(paths), np.int64)
        first = starts + np.arange(len(paths))
        inner = np.ones(len(at), bool)
        inner[first] = False
        at[inner] = nodes
        given = np.frombuffer(b"".join(sums), "<i8").reshape(-1, len(SUMS))
        self.sums = np.zeros((n, len(SUMS)), np.int64)
        self.sums[:, 1] = NOBODY
        for k in (0, 2, 3, 4):
            np.add.at(self.sums[:, k], at, given[:, k])
        np.minimum.at(self.sums[:, 1], at, given[:, 1])
        self.levels = np.searchsorted(self.trie.depth, np.arange(self.trie.depth[-1] + 2))

    def open_nodes(self, last: bool) -> np.ndarray:
        """Nodes on the paths to the first and the last row; none if no other shard is left."""
        mask = np.zeros(len(self.parent), bool)
        if not last:
            for x in (self.ends[0], self.ends[-1]):
                while x >= 0:
                    mask[x] = True
                    x = self.parent[x]
        return mask

    def roll_up(self, still_open: np.ndarray) -> None:
        """Adds every closed node to its parent, the last level first. Open nodes keep what hangs on them and aren't added."""
        s, parent = self.sums, self.parent
        for d in range(len(self.levels) - 2, -1, -1):
            own = np.arange(self.levels[d], self.levels[d + 1])
            own = own[~still_open[own]]
            s[own, 3] += (s[own, 2] == 0)
            s[own, 4] += (s[own, 0] - 1) * self.length[own]
            if not d:
                break
            up = parent[own]
            for k in (0, 3, 4):
                np.add.at(s[:, k], up, s[own, k])
            np.add.at(s[:, 2], up, 1)
            np.minimum.at(s[:, 1], up, s[own, 1])


def _whole(flat: np.ndarray) -> np.ndarray:
    """Digests as pairs of words: NumPy's byte strings would drop zeros at their ends."""
    return np.ascontiguousarray(flat).view([("a", "<u8"), ("b", "<u8")])


def key_of(path: bytes) -> bytes:
    """Identity of a node: 128 bits of its whole prefix."""
    return hashlib.blake2b(path, digest_size=16).digest()


#: kind 0: a node; 1: a path for the next level, with lengths and sums; 2: ids that end at an open node.
OUT = pa.schema([
    ("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("key", pa.binary()), ("up", pa.binary()),
    ("path", pa.binary()), ("lengths", pa.binary()), ("sums", pa.binary()),
])
OUT_DDL = (
    "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "key binary, up binary, path binary, lengths binary, sums binary"
)


def _empty_row(rows: dict[str, list], **values) -> None:
    for name in OUT.names:
        rows[name].append(values.get(name))


def _emit(shard: _Shard, ids: list[int] | None, last: bool) -> pa.RecordBatch:
    """What a shard gives: its closed nodes, the paths to its first and last row, and the ids that end on them."""
    still = shard.open_nodes(last)
    shard.roll_up(still)
    parent, sums, depth = shard.parent, shard.sums, shard.trie.depth
    rows: dict[str, list] = {x: [] for x in OUT.names}
    n = len(parent)
    # A row whose path goes through each node, for its prefix.
    via = np.full(n, -1, np.int64)
    via[shard.ends] = np.arange(len(shard.ends))
    for i in range(n - 1, 0, -1):
        if via[parent[i]] < 0:
            via[parent[i]] = via[i]
    prefix = lambda i: shard.paths[via[i]][: depth[i] * WIDTH]
    # Rows that end at each node are neighbours.
    hashes: dict[int, str] = {}
    if ids is not None:
        cuts = [0, *(np.flatnonzero(np.diff(shard.ends)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            text, node = ",".join(map(str, ids[a:b])).encode(), int(shard.ends[a])
            if still[node]:
                _empty_row(rows, kind=2, conv_id=ids[a], key=key_of(prefix(node)), path=text)
            else:
                hashes[node] = hashlib.sha256(text).hexdigest()
    closed, opened = np.flatnonzero(~still), np.flatnonzero(still)
    first = sums[:, 1]
    for i in closed.tolist():
        up = int(parent[i])
        waits = up >= 0 and bool(still[up])
        _empty_row(
            rows, kind=0, conv_id=int(first[i]), depth=int(depth[i]), parent_conv_id=None if up < 0 or waits else int(first[up]), n_convs=int(sums[i, 0]),
            n_children=int(sums[i, 2]), n_leaves=int(sums[i, 3]), saved_tokens=int(sums[i, 4]), ends_sha256=hashes.get(i, EMPTY_HASH) if ids is not None else None,
            key=key_of(prefix(i)) if ids is None else None, up=key_of(prefix(up)) if waits else None,
        )
    given: set[int] = set()
    for row in dict.fromkeys((0, len(shard.paths) - 1)) if len(opened) else ():
        chain, x = [], int(shard.ends[row])
        while x >= 0:
            chain.append(x)
            x = int(parent[x])
        chain.reverse()
        own = sums[chain].copy()
        for k, x in enumerate(chain):
            if x in given:  # both paths go through it; its sums went with the first
                own[k] = [0, NOBODY, 0, 0, 0]
        given.update(chain)
        _empty_row(rows, kind=1, path=shard.paths[row], lengths=shard.length[chain[1:]].astype("<i8").tobytes(), sums=own.astype("<i8").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in OUT], schema=OUT)


def _build(size: int, last: bool, with_ids: bool):
    """Sorted rows (path, lengths, conv_id or sums) to shards of about ``size`` turns, one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: list[bytes] = []
        lengths: list[bytes] = []
        third: list = []
        weight = 0

        def done() -> pa.RecordBatch:
            if not with_ids:
                return _emit(_Shard(paths, lengths, third), None, last)
            sums = []
            for path, conv in zip(paths, third, strict=True):
                own = np.zeros((len(path) // WIDTH + 1, len(SUMS)), "<i8")
                own[:, 1] = NOBODY
                own[-1, :2] = 1, conv
                sums.append(own.tobytes())
            return _emit(_Shard(paths, lengths, sums), third, last)

        for batch in batches:
            for path, length, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not last and weight >= size and len(paths) >= LEAST_ROWS:
                    yield done()
                    paths, lengths, third, weight = [], [], [], 0
                paths.append(path)
                lengths.append(length)
                third.append(x)
                weight += len(path) // WIDTH + 1
        if paths:
            yield done()

    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each key's ids, whose pieces come in order."""
    key, state, keys, found = None, None, [], []
    for batch in batches:
        for k, text in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist(), strict=True):
            if k != key:
                if state is not None:
                    keys.append(key)
                    found.append(state.hexdigest())
                key, state = k, hashlib.sha256(text)
            else:
                state.update(b"," + text)
    if state is not None:
        keys.append(key)
        found.append(state.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["ended", "hash"])


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(sequences: DataFrame, shard: int = SHARD, per_task: int = PER_TASK) -> DataFrame:
    """The nodes of the trie over sequences (conv_id long, path binary, lengths binary, which prefix_sequences makes).

    conv_ids are distinct. An empty table has no nodes. shard bounds a task's
    memory, however many conversations share a prefix or are copies; a single
    conversation is not cut.
    """
    spark = sequences.sparkSession
    tables = Tables(spark)
    sequences = tables.write(sequences, "sequences")
    kept: list[DataFrame] = []
    now, third, ids = sequences, "conv_id", True
    while True:
        turns, rows = now.agg(F.sum(F.length("path") / WIDTH + 1).cast("long"), F.count(F.lit(1))).first()
        if not rows:
            break
        last = turns <= shard or rows < LEAST_ROWS
        parts = 1 if last else max(1, min(-(-turns // per_task), rows // (2 * LEAST_ROWS)))
        order = ["path", "conv_id"] if ids else ["path"]
        dealt = (now.coalesce(1) if last else now.repartitionByRange(parts, *order)).sortWithinPartitions(*order)
        made = tables.write(dealt.select("path", "lengths", third).mapInArrow(_build(shard, last, ids), OUT_DDL), "trie-level")
        kept.append(made)
        if last:
            break
        now, third, ids = made.where("kind = 1"), "sums", False
    if not kept:
        tables.keep()
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    tables.keep(*kept)
    if len(kept) == 1:
        return kept[0].where("kind = 0").select(*NODE)
    # What the first level left open has its ids in pieces and is where waiting children find their parents.
    pieces = kept[0].where("kind = 2").select("key", "conv_id", "path").repartition("key").sortWithinPartitions("key", "conv_id")
    ends = pieces.mapInArrow(_hash_ends, "ended binary, hash string")
    upper = None
    for level in kept[1:]:
        own = level.where("kind = 0").select(*NODE, "key", "up")
        upper = own if upper is None else upper.unionByName(own)
    upper = upper.join(ends, F.col("key") == F.col("ended"), "left").withColumn("ends_sha256", F.coalesce("hash", F.lit(EMPTY_HASH)))
    upper = tables.write(upper.select(*NODE, "key", "up"), "trie-upper")
    names = upper.select(F.col("key").alias("above"), F.col("conv_id").alias("above_id"))
    if upper.count() <= BROADCAST_NODES:
        names = F.broadcast(names)
    every = kept[0].where("kind = 0").select(*NODE, "up").unionByName(upper.select(*NODE, "up"))
    named = every.join(names, F.col("up") == F.col("above"), "left")
    return named.select(*[F.coalesce("parent_conv_id", "above_id").alias(c) if c == "parent_conv_id" else F.col(c) for c in NODE])


def _sequence_rows(heads: int):
    """Rows sorted by (family, conversation, turn), a family's head first, to one sequence a conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own_family, family_head, own = None, None, [], []
        out: list[tuple[int, bytes, bytes]] = []
        size = 0

        def close() -> None:
            nonlocal size
            _, conv, is_head, take = now
            if is_head:
                family_head[:] = own[:heads]
            turns = family_head[:take] + own[take:]
            out.append((conv, b"".join(d for d, _ in turns), np.asarray([n for _, n in turns], "<i8").tobytes()))
            size += len(turns) + 1

        for batch in batches:
            for family, conv, is_head, take, digest, length in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if now is None or conv != now[1]:
                    if now is not None:
                        close()
                        own = []
                    if family != own_family:
                        own_family, family_head = family, []
                    now = (family, conv, is_head, take)
                own.append((digest, length))
            if size >= 100_000:
                yield _sequences(out)
                out, size = [], 0
        if now is not None:
            close()
        yield _sequences(out)

    return run


def _sequences(rows: list[tuple]) -> pa.RecordBatch:
    conv, path, lengths = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(path, pa.binary()), pa.array(lengths, pa.binary())], ["conv_id", "path", "lengths"])


def prefix_sequences(turns: DataFrame, family: Column | None = None, take: Column | None = None, heads: int = 0) -> DataFrame:
    """Each conversation of turns (conv_id, turn, role, text) as conv_id, path (its turns' digests), lengths (code points, 8 bytes each).

    Turns are ordered by turn (null first), then role and text; null role and
    text are empty; rows without a conv_id are left out; other columns are
    ignored. family and take rebuild conversations: the first ``take`` turns
    (``heads`` at most) are replaced by as many of conversation ``family``, as
    far as it has them.
    """
    conv = F.col("conv_id").cast("long")
    rows = turns.where(conv.isNotNull()).select(
        (family if family is not None else conv).alias("family"), conv.alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), (take if take is not None else F.lit(0)).cast("int").alias("take"),
    )
    rows = rows.withColumn("away", F.col("family") != F.col("conv"))
    rows = rows.repartition("family").sortWithinPartitions("family", "away", "conv", "turn", "role", "text")
    # The role's length keeps ("a", "bc") and ("ab", "c") apart.
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    rows = rows.select("family", "conv", (~F.col("away")).alias("head"), "take", digest.alias("digest"), F.length("text").cast("long").alias("length"))
    return rows.mapInArrow(_sequence_rows(heads), "conv_id long, path binary, lengths binary")


FAMILY, HEADS = 100, 6


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id").cast("long")
    take = F.crc32(conv.cast("string")) % HEADS
    return trie(prefix_sequences(table(spark, sf_dir, "conversations"), conv - conv % FAMILY, take, HEADS - 1))


#: The same nodes from every conversation's prefixes: subtrees are summed over each node's ancestors.
OP11_SQL = r"""
WITH crc AS (
    SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
    FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))
), convs AS (
    SELECT conv_id AS c, conv_id - conv_id % 100 AS family,
           xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
               lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc
), own AS (
    SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_key, length(coalesce(text, '')) AS len,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
    FROM conversations
), rebuilt AS (
    SELECT c, 0 AS part, p, turn_key, len FROM convs JOIN own ON own.conv_id = family AND p <= h
    UNION ALL SELECT c, 1, p, turn_key, len FROM convs JOIN own ON own.conv_id = c AND p > h
), numbered AS (
    SELECT c, turn_key, len, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d FROM rebuilt
), visits AS (
    SELECT c, d, md5(string_agg(turn_key, '') OVER (PARTITION BY c ORDER BY d)) AS k, len FROM numbered
    UNION ALL SELECT c, 0, '', 0 FROM convs
), nodes AS (
    SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, min(len) AS len FROM visits GROUP BY d, k
), above AS (
    SELECT n.d, n.k, p.conv_id AS parent_conv_id, p.d AS pd, p.k AS pk FROM nodes n JOIN visits v ON v.c = n.conv_id AND v.d = n.d - 1 JOIN nodes p ON p.d = v.d AND p.k = v.k
), fan AS (
    SELECT pd AS d, pk AS k, count(*) AS n_children FROM above GROUP BY pd, pk
), below AS (
    SELECT v.d, v.k, sum((n.n_convs - 1) * n.len) AS saved, count(*) FILTER (f.n_children IS NULL) AS leaves
    FROM nodes n LEFT JOIN fan f ON f.d = n.d AND f.k = n.k JOIN visits v ON v.c = n.conv_id AND v.d <= n.d GROUP BY v.d, v.k
), ends AS (
    SELECT d, k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, d, k FROM visits QUALIFY d = max(d) OVER (PARTITION BY c)) GROUP BY d, k
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, a.parent_conv_id, n.n_convs, coalesce(f.n_children, 0) AS n_children, b.leaves AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN above a ON a.d = n.d AND a.k = n.k LEFT JOIN fan f ON f.d = n.d AND f.k = n.k
JOIN below b ON b.d = n.d AND b.k = n.k LEFT JOIN ends e ON e.d = n.d AND e.k = n.k
"""
