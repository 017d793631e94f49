"""Best-fit packing of token ids into fixed-length sequences.

Texts are tokenized where they lie; only a row for each piece is shuffled. Each
packing task then runs bounded-space online best-fit: a fixed number of open
bins, found through a bitset keyed by free space; a piece goes into the fullest
bin that still takes it, and when a new bin is needed and none may be opened,
the fullest closes first.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Tables, table
from .tokens import UnitEncoder, default_tokenizer_path

LENGTH = 2048
OPEN_BINS = 4096
#: Tokens that one packing task takes on average; each leaves at most one bin poorly filled.
TOKENS_PER_TASK = 16_000_000
#: Texts are worked on in blocks of about so many characters.
BLOCK_CHARS = 400_000

_encoders: dict[str, UnitEncoder] = {}


#: Words that a worker process keeps, about 200 bytes each. A packing job by itself affords more than
#: one stage among others that share its workers.
CACHE_UNITS, CACHE_UNITS_ALONE = 100_000, 1_000_000


def encoder(path: str, cache_units: int = CACHE_UNITS) -> UnitEncoder:
    """One encoder for each worker process: its cache of words serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    _encoders[path].cache_units = cache_units
    return _encoders[path]


def text_blocks(column: pa.ChunkedArray | pa.Array, chars: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about ``chars`` characters each; null texts are empty. A longer text is a block of its own."""
    first, block, size = 0, [], 0
    for i, x in enumerate(column):
        text = x.as_py() or ""
        if block and size + len(text) > chars:
            yield first, block
            first, block, size = i, [], 0
        block.append(text)
        size += len(text)
    if block:
        yield first, block


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, mark long"


def _tokenize(path: str, length: int, end_id: int, with_ids: bool, cache_units: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, cache_units), np.asarray([end_id], "<u4").tobytes()
        step = 4 * length
        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in text_blocks(batch.column("text")):
                rows: list[list] = [[] for _ in range(6 + with_ids)]
                for i, raw in enumerate(enc.encode_batch(texts), first):
                    raw += end
                    doc, mark = ids[i].as_py(), zlib.crc32(raw)
                    for at in range(0, len(raw), step):
                        part = raw[at : at + step]
                        for to, x in zip(rows, (doc, at // step, at // 4, len(part) // 4, zlib.crc32(part), mark, part), strict=False):
                            to.append(x)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "mark", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=False)], names[: len(rows)])

    return run


def token_pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = 0, with_ids: bool = False, cache_units: int = CACHE_UNITS) -> DataFrame:
    """Pieces of every document's ids followed by end_id: doc_id, piece, start, length, ids_crc32, mark (crc32 of all its ids).

    Only documents of more than ``length`` ids are cut. Null and empty texts are
    the end id alone; null doc_ids are kept. with_ids adds the ids as bytes.
    """
    path = tokenizer or default_tokenizer_path()
    schema = PIECES + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenize(path, length, end_id, with_ids, cache_units), schema)


class BestFit:
    """Bounded-space online best-fit over pieces of 1..length tokens."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.open_bins = length, open_bins
        self.bits = 0  # bit f: an open bin has f tokens free
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]
        self.open = self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of the next piece."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            number, free = self.made, self.length
            self.made += 1
        left = free - size
        if left:
            self.bins[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.length - free

    def _take(self, free: int) -> int:
        found = self.bins[free]
        number = found.pop()
        if not found:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number


def pack(pieces: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, tokens_per_task: int = TOKENS_PER_TASK) -> DataFrame:
    """pieces with sequence_id and offset: each sequence has at most ``length`` tokens, laid without gaps.

    Full pieces are sequences of their own. The others are dealt evenly by a
    hash of what they are and of their order among rows alike, so repeated rows
    spread too, and are packed in hash order: reruns agree. Empty input: no rows.
    """
    spark = pieces.sparkSession
    pieces = Tables(spark).write(pieces, "pieces")
    total = pieces.where(F.col("length") < length).agg(F.sum("length")).first()[0] or 0
    tasks = max(1, math.ceil(total / tokens_per_task))
    keep = [c for c in pieces.columns if c != "mark"]
    full = pieces.where(F.col("length") == length).select(
        *keep, (F.lit(-1 - (1 << 62)) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.where(F.col("length") < length).withColumn("order", F.xxhash64("doc_id", "mark", "piece"))
    # Dealing takes the row's place in its file too: rows alike don't meet in one task.
    rest = rest.withColumn("task", F.pmod(F.xxhash64("order", F.monotonically_increasing_id()), F.lit(tasks)))
    dealt = rest.repartition(tasks, "task").sortWithinPartitions("task", "order", "doc_id", "piece", "ids_crc32")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*keep).schema) + ", sequence_id long, offset long"
    return dealt.mapInArrow(_pack_tasks(length, open_bins), schema).unionByName(full)


def _pack_tasks(length: int, open_bins: int):
    """One packer for each value of task, which come one after another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, BestFit] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            tasks = np.asarray(batch.column("task"))
            cuts = [0, *(np.flatnonzero(np.diff(tasks)) + 1).tolist(), len(tasks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                number = int(tasks[a])
                if number not in state:
                    state = {number: BestFit(length, open_bins)}
                fit, part = state[number], batch.slice(a, b - a)
                placed = [fit.place(x) for x in part.column("length").to_pylist()]
                keep = [c for c in batch.schema.names if c not in ("task", "mark", "order")]
                more = [pa.array([(number << 40) + x for x, _ in placed], pa.int64()), pa.array([x for _, x in placed], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + more, [*keep, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, cache_units: int = CACHE_UNITS, **options) -> DataFrame:
    return pack(token_pieces(docs, cache_units=cache_units), **options).withColumn("length", F.col("length").cast("long"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), cache_units=CACHE_UNITS_ALONE)
