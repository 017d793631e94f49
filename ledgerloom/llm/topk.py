"""Exact top-k inner products over norm-sorted, SVD-rotated blocks.

Vectors are dealt into ranges of descending length and packed into blocks. The
SVD of a bounded sample (through its Gram matrix; any rotation is exact, a good
one prunes more) gives a rotation that moves most of the length into the first
coordinates. Groups of packs meet all blocks of queries: a task holds its packs,
longest first, and the queries' blocks pass by it, each with its queries' k-th
best scores among the longest vectors of all. Where ||q|| ||x|| is below the
query's k-th best score the rest of the packs is skipped; else the partial
product over the leading rotated coordinates plus the Cauchy-Schwarz bound on
the rest discards most pairs; what is left is scored in exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import Tables, table

K = 20
SCALE = 64
#: Vectors in a pack, and queries in a block.
BLOCK, QUERY_BLOCK = 2_048, 1_024
#: Bytes of packs that one task holds; the queries' blocks are dealt to several tasks of one group of packs while there are fewer than TASKS.
GROUP_BYTES, TASKS = 32_000_000, 64
#: The rotation is fitted on about so many vectors, chosen by hash, in so many parts.
SAMPLE_VECTORS, SAMPLE_PARTS = 65_536, 8
#: Leading rotated coordinates: as many as hold LEAD_SHARE of the squared length, a half of all at most.
LEAD_SHARE = 0.8
#: Pairs scored at a time.
CHUNK_PAIRS = 1 << 21


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """id, v: floor(scale * component), norm. Vectors that are null or hold null or non-finite components are left out, null ids too; empty ones are in."""
    ok = F.col(vector_col).isNotNull() & F.forall(
        vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    v = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    got = df.where(ok & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return got.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as integers; shorter vectors end in zeros."""
    ends = np.asarray(column.offsets)
    flat = np.asarray(column.values)[ends[0] : ends[-1]]
    if len(flat) == len(column) * dim:
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim), np.int64)
    for i, (a, b) in enumerate(zip(ends - ends[0], (ends - ends[0])[1:], strict=False)):
        out[i, : b - a] = flat[a:b]
    return out


def _packer(dim: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                m = _matrix(part.column("v"), dim)
                norm = np.asarray(part.column("norm"))
                row = [pa.array([x]) for x in (float(norm.max(initial=0.0)), np.asarray(part.column("id")).astype(np.int64).tobytes(), m.astype(np.int64).tobytes())]
                yield pa.RecordBatch.from_arrays(row, ["top", "ids", "vectors"])

    return run


def _grams(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column("v"), dim).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["gram"])

    return run


def fit_rotation(vectors: DataFrame, dim: int, count: int) -> tuple[np.ndarray, int]:
    """(rotation, leading coordinates) of a bounded sample; SAMPLE_PARTS Gram matrices reach the driver, however large the table is."""
    share = min(1.0, SAMPLE_VECTORS / max(1, count))
    drawn = vectors.where(F.pmod(F.xxhash64("id", "norm"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v")
    rows = drawn.repartition(SAMPLE_PARTS).mapInArrow(_grams(dim), "gram binary").collect()
    values, rotation = np.linalg.eigh(sum((np.frombuffer(r["gram"], float).reshape(dim, dim) for r in rows), np.zeros((dim, dim))))
    values, rotation = np.maximum(values[::-1], 0), rotation[:, ::-1]
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    return rotation, int(min(max(1, dim // 2), np.searchsorted(share, LEAD_SHARE) + 1))


class Best:
    """The k best (score, id) seen for each query; ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), np.iinfo(np.int64).min)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        touched, local = np.unique(q, return_inverse=True)
        rows = np.concatenate([local, np.repeat(np.arange(len(touched)), self.k)])
        s = np.concatenate([scores, self.scores[touched].ravel()])
        i = np.concatenate([ids, self.ids[touched].ravel()])
        order = np.lexsort((i, -s.astype(float) if np.abs(s[s > np.iinfo(np.int64).min]).max(initial=0) < 2**53 else ~s, rows))
        rows, s, i = rows[order], s[order], i[order]
        first = np.searchsorted(rows, np.arange(len(touched)))
        take = first[:, None] + np.arange(self.k)
        self.scores[touched], self.ids[touched] = s[take], i[take]


class Queries:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, lead: int, floors: np.ndarray | None = None):
        self.ids, self.vectors, self.rotation, self.lead = ids, vectors, rotation, lead
        self.norm = np.sqrt((vectors.astype(float) ** 2).sum(1))
        turned = vectors @ rotation
        self.front, self.rest = turned[:, :lead], np.sqrt((turned[:, lead:] ** 2).sum(1))
        self.floors = np.full(len(ids), np.iinfo(np.int64).min) if floors is None else floors

    def search(self, best: Best, ids: np.ndarray, vectors: np.ndarray, top: float) -> None:
        """Adds what the block has to ``best``. Never discards a pair whose bound reaches the query's floor."""
        if self.norm.max(initial=0.0) * top >= 2.0**62:
            raise OverflowError("inner products don't fit 64 bits")
        floor = np.maximum(self.floors, best.floor()).astype(float)
        slack = 1e-6 * (self.norm * top + 1)
        alive = np.flatnonzero(self.norm * top + slack >= floor)
        if not len(alive):
            return
        x = vectors.astype(float)
        turned = x @ self.rotation
        front, rest = turned[:, : self.lead], np.sqrt((turned[:, self.lead :] ** 2).sum(1))
        exact = self.norm.max() * top < 2.0**52
        for at in range(0, len(alive), max(1, CHUNK_PAIRS // max(1, len(ids)))):
            some = alive[at : at + max(1, CHUNK_PAIRS // max(1, len(ids)))]
            bound = self.front[some] @ front.T + np.multiply.outer(self.rest[some], rest)
            q, c = np.nonzero(bound >= (floor[some] - slack[some])[:, None])
            if len(q) > 0.05 * bound.size and exact:
                score = (self.vectors[some].astype(float) @ x.T)[q, c].astype(np.int64)
            else:
                score = np.concatenate([np.einsum("ij,ij->i", self.vectors[some][q[i : i + 50_000]], vectors[c[i : i + 50_000]]) for i in range(0, max(1, len(q)), 50_000)])
            good = (score >= floor[some][q]) & (ids[c] != self.ids[some][q])
            if good.any():
                best.add(some[q[good]], score[good], ids[c[good]])


def _seed(shared, k: int, dim: int):
    """Adds to each block of queries the k-th best of each among the longest vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, lead, ids, vectors, top = shared.value
        for batch in batches:
            floors = []
            for own_ids, own in zip(batch.column("ids"), batch.column("vectors"), strict=True):
                block = Queries(np.frombuffer(own_ids.as_py(), np.int64), np.frombuffer(own.as_py(), np.int64).reshape(-1, dim), rotation, lead)
                best = Best(len(block.ids), k)
                block.search(best, ids, vectors, top)
                floors.append(best.floor().tobytes())
            columns = [batch.column(c) for c in ("block", "ids", "vectors")] + [pa.array(floors, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "vectors", "floors"])

    return run


def _search(shared, k: int, dim: int):
    """Rows in the order of group, part, kind: the group's packs (kind 0, longest first) are held, blocks of queries (kind 1) pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, lead = shared.value[:2]
        held_for, packs = None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("g", "part", "kind", "block", "top", "ids", "vectors", "floors")]
            for g, part, kind, block, top, ids, vectors, floors in zip(*columns, strict=True):
                here = (g.as_py(), part.as_py())
                if held_for != here:
                    held_for, packs = here, []
                ids, vectors = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(vectors.as_py(), np.int64).reshape(-1, dim)
                if kind.as_py() == 0:
                    packs.append((top.as_py(), ids, vectors))
                    continue
                own = Queries(ids, vectors, rotation, lead, np.frombuffer(floors.as_py(), np.int64))
                best = Best(len(ids), k)
                for pack_top, pack_ids, pack in packs:
                    own.search(best, pack_ids, pack, pack_top)
                q, place = np.nonzero(best.ids != np.iinfo(np.int64).max)
                out = [np.full(len(q), block.as_py()), q, ids[q], best.ids[q, place], best.scores[q, place]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["block", "place", "query_id", "vec_id", "score"])

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates (all, if fewer) other than those of its own id.

    Both frames: id, v (whole numbers), norm, as whole_vectors() gives. Vectors
    of fewer components than the longest count as ending in zeros, so an empty
    one scores 0. Rows that repeat an id all take part; a repeated query is
    answered as often as it comes. Raises OverflowError where products don't fit
    64 bits. No queries or candidates: no rows.

    Queries never pass through the driver; packs are shuffled once for each part
    of the queries, which are several only while groups of packs are few.
    """
    spark = candidates.sparkSession
    tables = Tables(spark)
    dim, count = 1, 0
    for x in (candidates, queries):
        longest, count = x.agg(F.max(F.size("v")), F.count("*")).first()
        dim = max(dim, int(longest or 0))
    count = candidates.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "top double, ids binary, vectors binary"
    rotation, lead = fit_rotation(candidates, dim, count)
    ranged = candidates.repartitionByRange(parts, F.col("norm").desc(), "id").sortWithinPartitions(F.col("norm").desc(), "id")
    packs = tables.write(ranged.mapInArrow(_packer(dim, BLOCK), schema).withColumn("pack", F.monotonically_increasing_id()), "packs")
    asked = tables.write(queries.sortWithinPartitions("id").mapInArrow(_packer(dim, QUERY_BLOCK), schema).withColumn("block", F.monotonically_increasing_id()), "queries")
    first = packs.orderBy(F.col("top").desc(), "pack").limit(1).collect()
    if not first or not asked.take(1):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    longest = np.frombuffer(first[0]["ids"], np.int64), np.frombuffer(first[0]["vectors"], np.int64).reshape(-1, dim), float(first[0]["top"])
    shared = spark.sparkContext.broadcast((rotation, lead, *longest))  # one pack and one rotation
    seeded = asked.select(F.hash("block").cast("long").alias("h"), "block", "ids", "vectors").repartition(parts, "h").mapInArrow(_seed(shared, k, dim), "block long, ids binary, vectors binary, floors binary")
    seeded = tables.write(seeded, "seeded")
    groups = max(1, -(-count * dim * 8 // GROUP_BYTES))
    salts = max(1, min(asked.count(), -(-TASKS // groups)))
    # Packs are dealt round about, so that each group has long and short ones and all take like time.
    nothing = lambda kind: F.lit(None).cast(kind)
    dealt = packs.select(
        F.pmod(F.xxhash64("pack"), F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("part"), F.lit(0).alias("kind"),
        F.col("pack").alias("block"), "top", "ids", "vectors", nothing("binary").alias("floors"),
    )
    passing = seeded.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("part"), F.lit(1).alias("kind"),
        "block", F.lit(0.0).alias("top"), "ids", "vectors", "floors",
    )
    rows = dealt.unionByName(passing).repartition(min(groups * salts, 20_000), "g", "part").sortWithinPartitions("g", "part", "kind", F.col("top").desc(), "block")
    best = tables.write(rows.mapInArrow(_search(shared, k, dim), "block long, place long, query_id long, vec_id long, score long"), "best")
    tables.keep(best)
    order = W.partitionBy("block", "place").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("id") % 20 == 0))


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20
"""
