"""Removal of repeated passages: windows of words that start earlier in the corpus, located by sharded Aho-Corasick automata.

Each window has an anchor, the word n-gram of least hash in it, so equal windows
have equal anchors; neighbouring windows with one anchor are a stretch. A range
sort of stretches by (anchor, digest) shows which anchors recur. Stretches that
are equal as a whole need no text: all but the first go. Where stretches around
one anchor differ, their words are fetched and sent to the anchor's shard. A
shard confirms the windows that really recur among them, compiles these into an
automaton, and streams the stretches through it in the order of documents: the
first place of a phrase stays, every later one is removed.

So each part of a document meets the one automaton that can know it, in place
of every document meeting every automaton, and work grows with the corpus.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Tables, table
from .ngrams import mix64
from .packing import text_blocks
from .shingles import word_hashes

#: Words of a window and of an anchor.
WINDOW, ANCHOR = 20, 8
#: A place is start * PLACES + number of windows; a stretch has at most window - anchor + 1 of them.
PLACES = 256
#: Anchors of more differing stretches than this are split: their windows are sent one by one, by what they say.
HOT = 4096
#: Words that one automaton is compiled from and streams before the next is begun.
SHARD_WORDS = 300_000
BLOCK_CHARS = 4_000_000
_G = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 2**64)
_SIGN = np.uint64(1 << 63)

#: What names a document: a null id is after all others; mark tells rows apart that share an id but not a text.
KEY = ["nil", "doc_id", "mark"]


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of every ``width`` neighbours, the leftmost of equal ones."""
    best, where, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        right = best[step:] < best[:-step]
        where = np.where(right, where[step:], where[:-step])
        best = np.where(right, best[step:], best[:-step])
        have += step
    return where


def stretches(texts: list[str], window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, anchor, digest) of every stretch: windows in a row that share an anchor."""
    words, counts = word_hashes(texts, lower=False)
    n = len(words) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, x) for x in (np.int64, np.int64, np.uint64, np.uint64))
    grams = np.zeros(len(words) - anchor + 1, np.uint64)
    for k in range(anchor):
        grams = mix64(grams * _G + words[k : k + len(grams)])
    best = least_of(grams, window - anchor + 1)
    owner = np.repeat(np.arange(len(texts)), counts)
    valid = np.flatnonzero(owner[:n] == owner[window - 1 :])
    if not len(valid):
        return tuple(np.zeros(0, x) for x in (np.int64, np.int64, np.uint64, np.uint64))
    fresh = np.ones(len(valid), bool)
    fresh[1:] = (np.diff(valid) != 1) | (best[valid[1:]] != best[valid[:-1]])
    at = np.flatnonzero(fresh)
    start, many = valid[at], np.diff(np.append(at, len(valid)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(words ^ _G) * _powers(_BASE, len(words)), dtype=np.uint64)])
    digest = mix64((sums[start + many + window - 1] - sums[start]) * _powers(_BACK, len(words))[start] + many.astype(np.uint64))
    first = np.concatenate([[0], np.cumsum(counts)])
    return owner[start], (start - first[owner[start]]) * PLACES + many, grams[best[start]], digest


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ _SIGN).view(np.int64)  # keeps the order


def _find(window: int, anchor: int):
    """Documents to their stretches. Of equal ones in a block all but the first are sure to go: they are spread over all anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(x) for x in KEY]
            nil, doc = (keys[i].to_numpy(zero_copy_only=False) for i in range(2))
            for first, texts in text_blocks(batch.column("text"), BLOCK_CHARS):
                text, place, gram, digest = stretches(texts, window, anchor)
                text += first
                order = np.lexsort((place, doc[text], nil[text], digest, gram))
                text, place, gram, digest = text[order], place[order], gram[order], digest[order]
                lead = np.arange(len(text))
                lead[1:] *= (gram[1:] != gram[:-1]) | (digest[1:] != digest[:-1])
                lead = np.maximum.accumulate(lead)
                one = text[lead]
                sure = (nil[text] != nil[one]) | (doc[text] != doc[one]) | (place != place[lead])
                gram = np.where(sure, mix64(doc[text].astype(np.uint64) * _G + place.astype(np.uint64)), gram)
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(gram)), pa.array(_signed(digest)), *[x.take(take) for x in keys], pa.array(place), pa.array(sure)], ["anchor", "digest", *KEY, "place", "sure"]
                )

    return run


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted stretches to those that go at once (open false) and those that must be compared by their words (open true).

    Memory: the firsts of one anchor's only digest so far. The anchors at both
    ends of a partition may go on in another, so they always count as recurring.
    """
    names = ["open", "anchor", *KEY, "place"]
    gram = digest = first = None
    several = True  # the anchor at hand has several digests, or may have
    waiting: dict[tuple, None] = {}

    def rows(it) -> pa.RecordBatch:
        cols = list(zip(*it, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array([True] * len(cols[0]), pa.bool_()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_()), *[pa.array(x, pa.int64()) for x in cols[2:]]], names
        )

    for batch in batches:
        sure = batch.filter(batch.column("sure"))
        if sure.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(sure.num_rows, bool)), *[sure.column(x) for x in names[1:]]], names)
            batch = batch.filter(pc.invert(batch.column("sure")))
        if not batch.num_rows:
            continue
        a, d, nil, doc, mark, place = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("anchor", "digest", *KEY, "place"))
        start, i = place // PLACES, np.arange(len(a))
        new_gram = np.append(gram is None or a[0] != gram, a[1:] != a[:-1])
        new_digest = new_gram | np.append(digest is None or d[0] != digest, d[1:] != d[:-1])
        lead = np.maximum.accumulate(np.where(new_digest, i, -1))
        at = np.maximum(lead, 0)
        is_first = (nil == nil[at]) & (doc == doc[at]) & (start == start[at])
        old = lead < 0
        if old.any():
            is_first[old] = (nil[old] == first[0]) & (doc[old] == first[1]) & (start[old] == first[2])
        group = np.cumsum(new_gram)  # 0: goes on from the batch before
        digests = np.bincount(group[new_digest], minlength=group[-1] + 1)
        many = digests > 1
        if gram is None:
            many[1] = True  # the partition's first anchor
        else:
            many[0] = several or digests[0] > 0
            if waiting and (many[0] or new_gram[0]):
                if many[0] and not new_gram[0]:
                    yield rows(waiting)
                waiting = {}
            elif waiting and group[-1] > 0 and not many[0]:
                waiting = {}
        shown = is_first & many[group]
        out = np.flatnonzero(~is_first | shown)
        if len(out):
            take = pa.array(out)
            yield pa.RecordBatch.from_arrays([pa.array(is_first[out]), *[batch.column(x).take(take) for x in names[1:]]], names)
        last = group[-1]
        several = bool(many[last])
        if not several:
            for j in np.flatnonzero(is_first & (group == last)).tolist():
                waiting[(int(a[j]), bool(nil[j]), int(doc[j]), int(mark[j]), int(place[j]))] = None
        gram, digest = a[-1], d[-1]
        if lead[-1] >= 0:
            j = lead[-1]
            first = (nil[j], doc[j], start[j])
    if waiting:
        yield rows(waiting)


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [pack.compress((x.as_py() or "").encode()) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in KEY], pa.array(packed, pa.binary())], [*KEY, "packed"])


def _words(packed: bytes) -> list[bytes]:
    """bytes.split() splits at a space and U+0009 to U+000D, and nothing else."""
    return zstandard.decompress(packed).split()


def _route(phrase: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(phrase, digest_size=8).digest(), "little", signed=True)


_STRETCH = ["route", *KEY, "start", "many", "words"]
_STRETCH_TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _cut(window: int):
    """Documents with places to their stretches' words; windows of split anchors one by one, equal ones of a batch by their first.

    A row without words is a window that goes already.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, single = [], {}
            for nil, doc, mark, packed, places in zip(*(batch.column(x).to_pylist() for x in (*KEY, "packed", "places")), strict=True):
                words = _words(packed)
                for x in places:
                    start, many = divmod(x["place"], PLACES)
                    if not x["split"]:
                        rows.append((x["anchor"], nil, doc, mark, start, many, b" ".join(words[start : start + many + window - 1])))
                        continue
                    for k in range(start, start + many):
                        phrase, own = b" ".join(words[k : k + window]), (nil, doc, k, mark)
                        had = single.get(phrase)
                        if had is None or own < had:
                            single[phrase], own = own, had
                        if own is not None:
                            # Equal places of rows that share an id stay both.
                            same = own[:3] == single[phrase][:3]
                            rows.append((_route(phrase), own[0], own[1], own[3], own[2], 1, phrase if same else None))
            rows += [(_route(phrase), nil, doc, mark, k, 1, phrase) for phrase, (nil, doc, k, mark) in single.items()]
            cols = list(zip(*rows, strict=True)) or [()] * len(_STRETCH)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, _STRETCH_TYPES, strict=True)], _STRETCH)

    return run


class PhraseShard:
    """Confirms, compiles and streams the stretches of some routes."""

    def __init__(self, window: int):
        self.window = window
        self.letters: dict[bytes, str] = {}
        self.firsts: dict[str, tuple] = {}

    def letter(self, word: bytes) -> str:
        """A word as one letter: automata then run over words. Surrogates are left out."""
        got = self.letters.get(word)
        if got is None:
            n = len(self.letters) + 1
            got = self.letters[word] = chr(n if n < 0xD800 else n + 0x800)
        return got

    def locate(self, rows: list[tuple], more: bool = False) -> list[tuple]:
        """rows (nil, doc_id, mark, start, words), in order within a route, to (nil, doc_id, mark, place) of later windows.

        more: rows of the last route are still to come, so what was seen once is remembered.
        """
        coded = ["".join([self.letter(w) for w in x[4].split(b" ")]) for x in rows]
        w = self.window
        seen = Counter(s[i : i + w] for s in coded for i in range(len(s) - w + 1))
        phrases = [p for p, n in seen.items() if n > 1 or p in self.firsts]
        automaton, out = ahocorasick.Automaton(), []
        for p in phrases:
            automaton.add_word(p, p)
        automaton.make_automaton()
        for (nil, doc, mark, start, _), s in zip(rows, coded, strict=True):
            gone: list[int] = []
            for end, p in automaton.iter(s) if phrases else ():
                k = start + end - w + 1
                first = self.firsts.get(p)
                if first is None:
                    self.firsts[p] = (nil, doc, k)
                elif first != (nil, doc, k):
                    gone.append(k)
            begin = None
            for i, k in enumerate(gone):
                begin = k if begin is None else begin
                if i + 1 == len(gone) or gone[i + 1] != k + 1 or k + 1 - begin == PLACES - 1:
                    out.append((nil, doc, mark, begin * PLACES + k + 1 - begin))
                    begin = None
        for (nil, doc, _, start, _), s in zip(rows, coded, strict=True) if more else ():
            for i in range(len(s) - w + 1):
                self.firsts.setdefault(s[i : i + w], (nil, doc, start + i))
        return out


def _locate(window: int, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, size, route, done = PhraseShard(window), [], 0, None, []

        def result(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.bool_()), *[pa.array(x, pa.int64()) for x in cols[1:]]], [*KEY, "place"])

        for batch in batches:
            for own, nil, doc, mark, start, many, words in zip(*(batch.column(x).to_pylist() for x in _STRETCH), strict=True):
                if words is None:
                    done.append((nil, doc, mark, start * PLACES + many))
                    continue
                if size >= shard_words and own != route or size >= 2 * shard_words:
                    # A new route starts afresh; one that fills an automaton by itself keeps its words and its first places.
                    yield result(shard.locate(rows, own == route))
                    rows, size = [], 0
                    if own != route:
                        shard = PhraseShard(window)
                route = own
                rows.append((nil, doc, mark, start, words))
                size += many + window - 1
            if done:
                yield result(done)
                done = []
        yield result(shard.locate(rows))

    return run


def _remove(window: int):
    names = ["doc_id", "n_words", "n_removed", "kept", "spans"]
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for nil, doc, packed, places in zip(*(batch.column(x).to_pylist() for x in ("nil", "doc_id", "packed", "places")), strict=True):
                words = _words(packed)
                gone = np.zeros(len(words) + 1, np.int64)
                if places:
                    start, many = np.divmod(np.asarray(places), PLACES)
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + many + window - 1, -1)
                gone = np.cumsum(gone)[:-1] > 0
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
                spans = [{"first": a, "words": b - a} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                kept = b" ".join(b" ".join(words[a:b]) for a, b in zip([0, *edge[1::2]], [*edge[::2], len(words)], strict=True) if b > a)
                rows.append((None if nil else doc, len(words), int(gone.sum()), kept.decode(), spans))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), spans_type]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names)

    return run


def drop_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every row of docs (doc_id, text) as doc_id, n_words, n_removed, kept (the words that stay, one space between) and spans (what went: first word, words).

    A window of ``window`` words whose words also start earlier, in a smaller
    doc_id or before it in the same document, is removed; windows are judged on
    the texts as they come. Null texts have no words; a null doc_id comes after
    all others. Rows with one doc_id are one document, read more than once:
    windows that start at the same word of it are not earlier than one another.
    Texts under ``window`` words and an empty table lose nothing. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    repeated = docs.select("doc_id").groupBy("doc_id").count().where("count > 1").take(1)
    mark = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    key = {"nil": F.col("doc_id").isNull(), "doc_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "mark": mark}
    texts = docs.select(*[x.alias(n) for n, x in key.items()], "text")
    anchor = min(ANCHOR, window)
    if window - anchor >= PLACES - 1:
        raise ValueError("windows of at most 262 words")
    kinds = "nil boolean, doc_id long, mark long"
    found = texts.mapInArrow(_find(window, anchor), f"anchor long, digest long, {kinds}, place long, sure boolean")
    dealt = found.repartitionByRange("anchor", "digest").sortWithinPartitions("anchor", "digest", *KEY[:2], "place")
    sifted = tables.write(dealt.mapInArrow(_sift, f"open boolean, anchor long, {kinds}, place long"), "repeats")
    opened = sifted.where("open")
    split = opened.groupBy("anchor").count().where(F.col("count") > hot).select("anchor", F.lit(True).alias("split"))
    opened = opened.join(split, "anchor", "left").select(*KEY, F.struct("place", "anchor", F.coalesce("split", F.lit(False)).alias("split")).alias("at"))
    packed = texts.mapInArrow(_zip, f"{kinds}, packed binary")
    cut = packed.join(opened.groupBy(*KEY).agg(F.collect_set("at").alias("places")), KEY)
    cut = cut.select(*KEY, "packed", "places").mapInArrow(_cut(window), f"route long, {kinds}, start long, many long, words binary")
    shards = cut.repartition("route").sortWithinPartitions("route", *KEY[:2], "start")
    located = tables.write(shards.mapInArrow(_locate(window, shard_words), f"{kinds}, place long"), "located")
    gone = sifted.where("NOT open").select(*KEY, "place").unionByName(located).groupBy(*KEY).agg(F.collect_set("place").alias("places"))
    whole = packed.join(gone, KEY, "left").select("nil", "doc_id", "packed", "places")
    return whole.mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept string, spans array<struct<first:long,words:long>>")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window as text, its first place, and the words that a later one covers.
OP12_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), words AS (
    SELECT r, doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d
), windows AS (
    SELECT r, doc_id, i, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS phrase
    FROM words QUALIFY i <= n - 19
), later AS (
    SELECT r, i FROM windows QUALIFY rank() OVER (PARTITION BY phrase ORDER BY doc_id NULLS LAST, i) > 1
), covered AS (
    SELECT w.r, w.i, w.word, max(l.i) OVER (PARTITION BY w.r ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
    FROM words w LEFT JOIN later l ON l.r = w.r AND l.i = w.i
), kept AS (
    SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM covered GROUP BY r
)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON k.r = d.r
"""
