"""Near duplicates by SetSketch registers, banded, estimated by likelihood, then verified.

A register keeps the exponentially spaced, truncated minimum of exponential
hashes of a set's shingles; sketches of sets merge into their union's by the
maximum, and equal registers are as likely as the sets are similar. Exact copies
are one class from the start. Classes that share a band of registers are
candidates: first each with its band's hub, its least class, then, where a
band still holds several components, with further ones and across these. Candidates' similarity is estimated
jointly from their registers by maximum likelihood; those that may reach the
threshold are compared on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Tables, fresh, table
from .components import connected
from .ngrams import mix64
from .packing import text_blocks
from .shingles import shingle_sets

BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
#: Base and rate of the registers' spacing; with LEVELS they cover sets of 1 to 10^11 shingles.
BASE, RATE, LEVELS = 1.0005, 20.0, 65_534
#: Links have 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
#: Pairs estimated below this are not verified: five standard errors of the estimate under the threshold.
LEAST_ESTIMATE = 0.58
#: Up to so many ids (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Members on either side that one task compares at a time, and those that one task verifies against one class.
BLOCK, VERIFY_BLOCK = 512, 64
#: A band of more members than this is joined by broadcasting its key, lest one task gets it.
HEAVY = 100_000
#: While blocks of a band would look at more than ROUND_COST pairs (its odd members times its members), it is compared
#: with one class more, which costs a pair a member: so many rounds at most. The rest is left to the blocks, which are exact.
ROUNDS, ROUND_COST = 3, 1 << 27

_G = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1, REGISTERS + 1, dtype=np.uint64) * _G


def sketches(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Registers (texts x REGISTERS) of the sets hashes[ends[i]:ends[i + 1]]; 0 for empty sets.

    An element visits all registers in a random order of its own (Fisher-Yates,
    drawn from its hash as far as it gets), at the increasing times of REGISTERS
    exponential clocks; it stops once its time is above all that the set's
    registers hold.
    """
    count = len(ends) - 1
    times = np.full(count * REGISTERS, np.inf)
    owner = np.repeat(np.arange(count), np.diff(ends))
    h = hashes
    draws = mix64(h ^ _G)
    order = np.zeros((0, REGISTERS), np.uint8)
    x = np.zeros(len(h))
    for k in range(REGISTERS):
        if not len(h):
            break
        u = (mix64(h + _STEPS[k]) >> np.uint64(11)).astype(float) * 2.0**-53
        x = x - np.log1p(-u) / (REGISTERS - k)
        at = k + ((mix64(draws + _STEPS[k]) >> np.uint64(32)) % np.uint64(REGISTERS - k)).astype(np.int64)
        if k:
            every = np.arange(len(h))
            swapped = at
            at = order[every, swapped].astype(np.int64)
            order[every, swapped] = order[:, k]
        np.minimum.at(times, owner * REGISTERS + at, x)
        if k < 8 or k % 4 == 3:
            change = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
            active = owner[change]
            worst = times.reshape(count, REGISTERS)[active].max(1)
            keep = x < np.repeat(worst, np.diff(np.append(change, len(owner))))
            h, owner, draws, x, at = h[keep], owner[keep], draws[keep], x[keep], at[keep]
            order = order[keep] if k else order
        if not k:  # the first visit needs no table, and of a large set few elements make a second
            order = np.tile(np.arange(REGISTERS, dtype=np.uint8), (len(h), 1))
            order[np.arange(len(h)), at] = 0
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(times / RATE) / np.log(BASE))
    return np.where(np.isinf(times), 0, np.clip(level, 1, LEVELS + 1)).astype(np.uint16).reshape(count, REGISTERS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, texts x BANDS."""
    r = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * _G)[None, :].repeat(len(registers), 0)
    for k in range(ROWS):
        key = mix64(key * _G + r[:, :, k])
    return key


_GRID = np.linspace(0, 1, 101)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches whose sets have na and nb elements."""
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - above - below
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = _GRID[None, :]

    def p(t: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(t, 0) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    same = 1 - up - down
    tiny = 1e-12
    like = above * np.log(np.maximum(up, tiny)) + below * np.log(np.maximum(down, tiny)) + equal * np.log(np.maximum(same, tiny))
    like[j * np.maximum(u, v) > np.minimum(u, v) + 1e-9] = -np.inf
    return _GRID[np.argmax(like, 1)]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in text_blocks(batch.column("text")):
            h, ends = shingle_sets(texts)
            registers = sketches(h, ends)
            n = np.diff(ends)
            full = n > 0
            d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if full.any():
                starts = ends[:-1][full]
                d1[full] = np.add.reduceat(mix64(h), starts)
                d2[full] = np.add.reduceat(mix64(h * _G + np.uint64(1)), starts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                    pa.array([x.tobytes() if k else None for x, k in zip(registers, full, strict=True)], pa.binary()),
                ],
                ["doc_id", "n", "d1", "d2", "sketch"],
            )


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint16).reshape(-1, REGISTERS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_registers(batch.column("sketch")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(batch.column("id")), BANDS))], ["key", "id"]
            )


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            na, nb = np.asarray(batch.column("na")).astype(float), np.asarray(batch.column("nb")).astype(float)
            good = estimate(_registers(batch.column("sa")), _registers(batch.column("sb")), na, nb) >= LEAST_ESTIMATE
            yield batch.select(["a", "b"]).filter(pa.array(good))


def _fits(x, y):
    """Sets of these sizes can reach the threshold."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * THRESHOLD


def _prune(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and registers allow a link."""
    side = nodes.select("id", "n", "sketch")
    one = pairs.join(side.toDF("ia", "na", "sa"), F.col("a") == F.col("ia"))
    both = one.join(side.toDF("ib", "nb", "sb"), F.col("b") == F.col("ib")).where(_fits(F.col("na"), F.col("nb")))
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_likely, "a long, b long")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in text_blocks(batch.column("text")):
            h, ends = shingle_sets(texts)
            sets = [h[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(sets, pa.binary())], ["doc_id", "set"])


def _sets_of(docs: DataFrame, ids: DataFrame, tables: Tables) -> DataFrame:
    """doc_id, set (sorted hashes as bytes) of the documents in ids (column id, a table), one row an id, made once."""
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id"), "left_semi")
    return tables.write(texts.mapInArrow(_shingle_rows, "doc_id long, set binary"), "sets")


def _set(x) -> np.ndarray:
    return np.frombuffer(x.as_py(), np.uint64)


def _common(small: np.ndarray, large: np.ndarray) -> int:
    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[place] == small).sum())


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of group, salt, member: the group's own sets come first and are held."""
    held_for, held = None, []
    for batch in batches:
        a, b = [], []
        for g, salt, member, own in zip(*(batch.column(c) for c in ("g", "salt", "member", "set")), strict=True):
            here, own = (g.as_py(), salt.as_py()), _set(own)
            if member.as_py() is None:
                if held_for != here:
                    held_for, held = here, []
                held.append(own)
            elif held_for == here and len(own):
                for x in held:
                    small, large = (own, x) if len(own) <= len(x) else (x, own)
                    common = _common(small, large) if len(small) else 0
                    if len(small) and 100 * common >= THRESHOLD * (len(own) + len(x) - common):
                        a.append(here[0])
                        b.append(member.as_py())
                        break
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _verify(pairs: DataFrame, docs: DataFrame, tables: Tables) -> DataFrame:
    """The pairs (a, b), each given once, that link on their full sets, as a table.

    Members are dealt to a with a salt, about VERIFY_BLOCK a task group, so a
    class with very many candidates is spread; its own set goes to each.
    """
    pairs = tables.write(pairs, "pairs")
    groups = tables.write(pairs.groupBy("a").agg(F.ceil(F.count("*") / VERIFY_BLOCK).cast("int").alias("salts")), "groups")
    salt = F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")
    members = pairs.join(groups.withColumnRenamed("a", "ga"), F.col("a") == F.col("ga")).select(F.col("b").alias("id"), F.col("a").alias("g"), salt.alias("salt"), F.col("b").alias("member"))
    owners = groups.select(F.col("a").alias("id"), F.col("a").alias("g"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("member"))
    wanted = members.unionByName(owners)
    ids = tables.write(wanted.select("id").distinct(), "ids")
    sets = _sets_of(docs, ids, tables)
    rows = wanted.join(sets, F.col("id") == F.col("doc_id")).select("g", "salt", "member", "set")
    dealt = rows.repartition(F.col("g"), F.col("salt")).sortWithinPartitions("g", "salt", F.col("member").asc_nulls_first())
    links = tables.write(dealt.mapInArrow(_compare, "a long, b long"), "links")
    tables.drop(pairs, groups, ids, sets)
    return links


def _first_band(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band in which registers a share all of their rows with each row of b; BANDS if none."""
    same = (a.reshape(BANDS, ROWS)[None] == b.reshape(-1, BANDS, ROWS)).all(2)
    return np.where(same.any(1), same.argmax(1), BANDS)


def _link_group(g: dict, emit: list) -> None:
    """Links between components among the members of one block pair of a band; one for each pair of components.

    Left are members outside the band's largest component, right are any. A pair
    is compared in the first band that it shares, once where both are on either
    side, and not if one of it is the band's hub, with which all were compared.
    """
    ids, comp, size, reg, sets = g["id"], g["c"], g["n"].astype(float), g["sketch"], g["set"]
    left, right = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)
    if not len(left) or not len(right):
        return
    key = np.int64(g["key"][0]).view(np.uint64)
    band = int(np.argmax(band_keys(reg[:1])[0] == key))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    hub, odd = g["hub"][0], g["odd"]
    for i in left:
        if ids[i] == hub:
            continue
        fits = np.minimum(size[right], size[i]) * 100 >= np.maximum(size[right], size[i]) * THRESHOLD
        js = right[fits & (comp[right] != comp[i]) & (ids[right] != hub) & (~odd[right] | (ids[right] > ids[i]))]
        if len(js):
            js = js[_first_band(reg[i], reg[js]) == band]
        if len(js):
            est = estimate(np.broadcast_to(reg[i], (len(js), REGISTERS)), reg[js], np.full(len(js), size[i]), size[js])
            js = js[est >= LEAST_ESTIMATE]
        js = js[[root(int(comp[j])) != root(int(comp[i])) for j in js]] if len(js) else js
        if not len(js):
            continue
        mine = _set(sets[i])
        for j in js:
            if root(int(comp[i])) == root(int(comp[j])):
                continue
            other = _set(sets[j])
            common = _common(mine, other) if len(mine) <= len(other) else _common(other, mine)
            if 100 * common >= THRESHOLD * (len(mine) + len(other) - common):
                ci, cj = root(int(comp[i])), root(int(comp[j]))
                parent[max(ci, cj)] = min(ci, cj)
                emit.append((int(ids[i]), int(ids[j])))


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of key, x, y: links across components, verified on the full sets where they are found."""
    names = ["key", "x", "y", "side", "odd", "id", "c", "hub", "n"]
    rest: dict | None = None

    def links(now: dict, edges: list[int]) -> Iterator[pa.RecordBatch]:
        emit: list[tuple[int, int]] = []
        for s, e in zip(edges, edges[1:], strict=False):
            _link_group({c: v[s:e] for c, v in now.items()}, emit)
        if emit:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in emit], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: np.asarray(batch.column(c)) for c in names} | {"sketch": _registers(batch.column("sketch")), "set": list(batch.column("set"))}
        if rest is not None:
            now = {c: rest[c] + now[c] if c == "set" else np.concatenate([rest[c], now[c]]) for c in now}
        cut = np.flatnonzero((np.diff(now["key"]) != 0) | (np.diff(now["x"]) != 0) | (np.diff(now["y"]) != 0)) + 1
        edges = [0, *cut.tolist()]
        yield from links(now, edges)
        rest = {c: v[edges[-1] :] for c, v in now.items()}
    if rest is not None:
        yield from links(rest, [0, len(rest["id"])])


def _members(bands: DataFrame, keys: DataFrame) -> DataFrame:
    """key, id, hub, size of the bands in keys (k, hub, size): those of very many members by broadcasting their few keys."""
    heavy = keys.where(F.col("size") > HEAVY)
    light = keys.where(F.col("size") <= HEAVY)
    if heavy.count() > BROADCAST_IDS:
        heavy, light = keys.limit(0), keys
    both = [bands.join(light, F.col("key") == F.col("k")), bands.join(F.broadcast(heavy), F.col("key") == F.col("k"))]
    return both[0].unionByName(both[1]).select("key", "id", "hub", "size")


def _open_members(members: DataFrame, found: DataFrame, tables: Tables) -> DataFrame:
    """key, id, hub, size, c, odd of the bands that hold several components; odd: outside the band's largest one."""
    known = found.select(F.col("id").alias("i"), F.col("component").alias("c"))
    placed = members.where("size > 2").join(known, F.col("id") == F.col("i"), "left").select("key", "id", "hub", "size", F.coalesce("c", "id").alias("c"))
    placed = tables.write(placed, "placed")
    parts = placed.groupBy("key", "c").agg(F.count("*").alias("m"))
    open_keys = parts.groupBy("key").agg(F.max(F.struct("m", "c")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select(F.col("key").alias("k"), F.col("top.c").alias("most"), F.col("top.m").alias("m"))
    open_keys = tables.write(open_keys, "open")
    out = tables.write(placed.join(open_keys, F.col("key") == F.col("k")).select("key", "id", "hub", "size", "c", (F.col("c") != F.col("most")).alias("odd"), (F.col("size") - F.col("m")).alias("odds")), "open-members")
    tables.drop(placed, open_keys)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Null, empty and blank texts have no shingles and link with nothing. Rows
    with a null doc_id are kept and not linked. Rows that share a doc_id share a
    component, and are all kept if it is their own. Texts are read whole; other
    columns play no part. Empty input: no rows.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = tables.write(base.mapInArrow(_signatures, "doc_id long, n long, d1 long, d2 long, sketch binary"), "signatures")
    classes = signed.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(
        F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")
    )
    nodes = tables.write(classes, "classes")
    bands = tables.write(nodes.select("id", "sketch").mapInArrow(_bands, "key long, id long"), "bands")
    # A band's hub is its least class: the bands of one large group then have few hubs between them, and few distinct pairs.
    keys = bands.groupBy(F.col("key").alias("k")).agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    keys = tables.write(keys, "keys")
    members = tables.write(_members(bands, keys), "members")
    tables.drop(bands)
    stars = members.where("id <> hub").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b"))
    links = _verify(_prune(stars.distinct(), nodes), base, tables)
    found = connected(spark, links)
    left = _open_members(members, found, tables)
    for turn in range(ROUNDS):
        dear = (F.col("size") * F.col("odds") > ROUND_COST) & (F.col("odds") > 1)
        if not left.where(dear).take(1):
            break
        # Each dear band is compared with one of its odd members more.
        drawn = F.min(F.struct(F.xxhash64("key", "id", F.lit(turn)).alias("h"), F.col("id"), F.col("c")))
        more = left.where(dear & F.col("odd")).groupBy(F.col("key").alias("k")).agg(drawn.alias("d")).select("k", F.col("d.id").alias("next"), F.col("d.c").alias("nc"))
        more = tables.write(more, "hubs")
        stars = left.join(F.broadcast(more) if more.count() <= BROADCAST_IDS else more, F.col("key") == F.col("k")).where("c <> nc")
        stars = stars.select(F.least("next", "id").alias("a"), F.greatest("next", "id").alias("b")).distinct()
        links = tables.write(links.unionByName(_verify(_prune(stars, nodes), base, tables)), "links")
        found = connected(spark, links)
        tables.drop(left, more)
        left = _open_members(members, found, tables)

    # Bands that still hold several components: those outside the largest meet all members in blocks, which emit only links.
    if left.take(1):
        rows_, columns_ = F.ceil(F.col("odds") / BLOCK).cast("int"), F.ceil(F.col("size") / BLOCK).cast("int")
        at = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        seekers = left.where("odd").select("key", "id", "c", "hub", "odd", F.lit(0).alias("side"), at(rows_, 1).alias("x"), every(columns_).alias("y"))
        sought = left.select("key", "id", "c", "hub", "odd", F.lit(1).alias("side"), every(rows_).alias("x"), at(columns_, 2).alias("y"))
        ids = tables.write(left.select("id").distinct(), "ids")
        sets = _sets_of(base, ids, tables)
        full = tables.write(sets.join(nodes.select(F.col("id").alias("ni"), "n", "sketch"), F.col("doc_id") == F.col("ni")).drop("ni"), "full")
        dealt = seekers.unionByName(sought).join(full, F.col("id") == F.col("doc_id")).drop("doc_id").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side", "id")
        links = tables.write(links.unionByName(dealt.mapInArrow(_cross, "a long, b long")), "links")
        found = connected(spark, links)

    label = nodes.select("d1", "d2", "n", "id", "copies").join(found.toDF("i", "c"), F.col("id") == F.col("i"), "left")
    label = label.where("copies > 1 or c is not null").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("n").alias("en"), F.coalesce("c", "id").alias("c"))
    label = tables.write(label, "labels")
    tables.keep(signed, label)
    same = (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") == F.col("en")) & F.col("doc_id").isNotNull()
    out = signed.drop("sketch").join(label, same, "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without those that are not kept; of rows that repeat a kept doc_id one stays.

    Null doc_ids stay, and so do null, empty and blank texts. Columns may have
    any names besides doc_id and text; nulls in them play no part. No rows: none.
    """
    tables = Tables(docs.sparkSession)
    judged = tables.write(near_duplicates(docs), "judged")
    (name,) = fresh(docs, "gone")
    gone = tables.write(judged.where("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    left = docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col(name), "left_anti")
    if judged.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1):
        left = left.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(left.where("doc_id is null"))
    return left


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, compared on full sets, and the least doc_id that links lead to.
OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [hash(array_to_string(ws, ' ') || ' ')]
        ELSE list_transform(range(len(ws) - 4), lambda i: hash(array_to_string(ws[(i + 1)::INTEGER:(i + 5)::INTEGER], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT doc_id, min(g) AS a, max(g) AS b, sum(g) AS t, count(*) AS n FROM s GROUP BY 1),
r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY a, b, t, n) AS rep FROM c),
d AS (SELECT s.doc_id, g FROM s JOIN r ON r.doc_id = s.doc_id AND rep = s.doc_id),
x AS (SELECT l.doc_id AS i, m.doc_id AS j, count(*) AS k FROM d l JOIN d m ON l.g = m.g AND l.doc_id < m.doc_id GROUP BY 1, 2),
e AS (SELECT i, j FROM x JOIN n p ON p.doc_id = i JOIN n q ON q.doc_id = j WHERE 100 * k >= 75 * (p.n + q.n - k) UNION SELECT rep, doc_id FROM r WHERE rep < doc_id),
b AS (SELECT i, j FROM e UNION SELECT j, i FROM e),
walk(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.j, walk.c FROM walk JOIN b ON b.i = walk.doc_id WHERE walk.c < b.j),
f AS (SELECT doc_id, min(c) AS c FROM walk GROUP BY 1)
SELECT f.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, f.c AS component_id, f.doc_id = f.c AS kept FROM f LEFT JOIN n ON n.doc_id = f.doc_id
"""
