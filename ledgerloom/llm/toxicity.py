"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of its words and of their character n-grams, hashed into
buckets. Each bucket has an embedding; their average goes through a linear
softmax. Embeddings and softmax are trained together, so a misspelling that was
never seen is near the words with which it shares n-grams.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import fresh, table
from .language_id import grams
from .ngrams import code_points, letter_table, mix64
from .packing import text_blocks

SIZES = (3, 4, 5)
BUCKET_BITS = 17
#: The classifier is fitted on about so many labelled documents of each class, chosen by hash.
SAMPLE_DOCS = 1_500
DIM, EPOCHS, MIN_STEPS, BATCH, RATE, SEED = 8, 8, 200, 64, 0.2, 7
#: Averages are multiplied by this before the softmax: a few toxic words are a small share of a text.
SCALE = 20.0
#: Scores are calibrated so that a text is predicted toxic from here on.
THRESHOLD = 0.3


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every word and n-gram of the whole texts, repeats included."""
    mask, shift = np.uint64((1 << BUCKET_BITS) - 1), np.uint64(20)
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    parts += [((h >> shift) & mask, owner) for _, h, owner in grams(texts, SIZES)]
    flat, starts = code_points(texts)
    letter = letter_table()[flat].astype(np.int8)
    edge = np.diff(letter, prepend=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(first):
        # A word's hash: sum over its letters of mixed (letter, place).
        place = np.arange(len(flat), dtype=np.uint64)
        inside = letter.astype(bool)
        own = np.repeat(first, last - first).astype(np.uint64)
        mixed = mix64(flat[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (place[inside] - own))
        word = mix64(np.add.reduceat(mixed, np.concatenate([[0], np.cumsum(last - first)[:-1]])))
        parts.append(((word >> shift) & mask, np.searchsorted(starts, first, side="right") - 1))
    return np.concatenate([x for x, _ in parts]).astype(np.int64), np.concatenate([x for _, x in parts])


@dataclass
class Model:
    """A bucket's share of the log odds, per feature of the average, and the calibrated line that ends in a logistic."""

    weight: np.ndarray
    slope: float
    intercept: float

    def scores(self, texts: list[str]) -> np.ndarray:
        bucket, owner = features(texts)
        n = np.bincount(owner, minlength=len(texts))
        raw = np.bincount(owner, self.weight[bucket], minlength=len(texts)) / np.maximum(1, n)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * raw + self.intercept, -50, 50)))


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray) -> Model:
    """docs: (buckets, shares of the average) of each text. weights: how many documents each stands for."""
    buckets = 1 << BUCKET_BITS
    if len(docs) == 0 or labels.min() == labels.max():
        prior = float(np.average(labels, weights=weights)) if len(docs) else 0.0
        odds = np.log(np.clip(prior, 1e-4, 1 - 1e-4) / (1 - np.clip(prior, 1e-4, 1 - 1e-4)))
        return Model(np.zeros(buckets, np.float32), 0.0, float(odds))
    y = labels.astype(float)
    folds = 2 if len(docs) > 1000 else 4
    fold = np.random.default_rng(SEED).permutation(len(docs)) % folds
    raw = np.zeros(len(docs))
    for k in range(folds):  # log odds of texts that a model hasn't seen, for the calibration
        own = fold == k
        w, b = _fit([docs[i] for i in np.flatnonzero(~own)], y[~own], np.random.default_rng(SEED))
        raw[own] = [w[i] @ s for i, s in (docs[j] for j in np.flatnonzero(own))]
    w, _ = _fit(docs, y, np.random.default_rng(SEED))
    slope, intercept = _calibrate(raw, y, weights)
    return Model(w.astype(np.float32), slope, intercept)


def _fit(docs, y, rng) -> tuple[np.ndarray, float]:
    """Adagrad on embeddings, softmax and bias together. With two classes the embeddings' gradient has rank one."""
    seen = np.zeros(1 << BUCKET_BITS, bool)
    for i, _ in docs:
        seen[i] = True
    used = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.int32)
    place[used] = np.arange(len(used))
    local = [place[i] for i, _ in docs]
    e = rng.normal(0, 1 / DIM, (len(used), DIM)).astype(np.float32)
    v = rng.normal(0, 0.1, (2, DIM))
    bias = np.zeros(2)
    sum_e, sum_v, sum_b = np.full(len(used), 1e-8), np.full((2, DIM), 1e-8), np.full(2, 1e-8)
    batches = -(-len(docs) // BATCH)
    for _ in range(max(EPOCHS, -(-MIN_STEPS // batches))):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            n = [len(local[j]) for j in some]
            idx = np.concatenate([local[j] for j in some])
            share = np.concatenate([docs[j][1] for j in some]) * SCALE
            h = np.add.reduceat(e[idx] * share[:, None], np.concatenate([[0], np.cumsum(n)[:-1]])).astype(float)
            z = h @ v.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some].astype(int)] -= 1
            p /= len(some)
            toward = v[1] - v[0]
            c = np.bincount(idx, share * np.repeat(p[:, 1], n), len(used))
            gv, gb = p.T @ h, p.sum(0)
            sum_e += c * c * float(toward @ toward) / DIM
            sum_v += gv**2
            sum_b += gb**2
            e -= ((RATE * c / np.sqrt(sum_e))[:, None] * toward).astype(np.float32)
            v -= RATE * gv / np.sqrt(sum_v)
            bias -= RATE * gb / np.sqrt(sum_b)
    out = np.zeros(1 << BUCKET_BITS)
    out[used] = e @ (v[1] - v[0]) * SCALE
    return out, float(bias[1] - bias[0])


def _calibrate(raw: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on raw with weights, by Newton's method."""
    x = np.stack([raw, np.ones_like(raw)], 1)
    scale = max(1e-9, float(np.std(raw)))
    x[:, 0] /= scale
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        g = x.T @ (weights * (p - y)) + 1e-3 * b
        h = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(0.0, b[0]) / scale), float(b[1])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in enumerate(batch.column("text").to_pylist()):
            bucket, _ = features([text or ""])
            used, count = np.unique(bucket, return_counts=True)
            share = (count / max(1, len(bucket))).astype(np.float32)
            row = [pa.array([batch.column("toxic")[i].as_py()], pa.int32()), pa.array([used.astype(np.int32).tobytes()]), pa.array([share.tobytes()])]
            yield pa.RecordBatch.from_arrays(row, ["toxic", "buckets", "shares"])


def learn_toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic 0 or 1).

    Labels that are null or have no document teach nothing; of several for one
    doc_id the largest counts. The sample's bound: about ``sample_docs``
    documents of each class, those whose doc_id's hash is lowest; only their
    labels are broadcast, and only bags of bucket numbers reach the driver.
    Without labels of both classes every text gets the same score.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["c"] for r in known.groupBy("toxic").agg(F.count("*").alias("c")).collect()}
    if not counts:
        return train([], np.zeros(0), np.zeros(0))
    share = F.element_at(F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, min(1.0, sample_docs / c))]), F.col("toxic"))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    rows = joined.mapInArrow(_bags, "toxic int, buckets binary, shares binary").collect()
    rows.sort(key=lambda r: (bytes(r["buckets"]), bytes(r["shares"]), r["toxic"]))  # reruns agree
    rows = [rows[i] for i in np.random.default_rng(SEED).permutation(len(rows))]
    bags = [(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in rows]
    full = [(bag, r["toxic"]) for bag, r in zip(bags, rows, strict=True) if len(bag[0])]
    y = np.asarray([t for _, t in full])
    weights = np.asarray([counts[t] / max(1, int((y == t).sum())) for t in y], float)
    return train([bag for bag, _ in full], y, weights)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from threshold on). Null texts count as empty, which have a score too.

    Texts are read whole. Columns of docs that have these two names already are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # 4 bytes a bucket
    docs = docs.drop(score_col, predicted_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType())])
    cache: dict[str, Model] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cache.setdefault("model", pickle.loads(shared.value))
        for batch in batches:
            for first, texts in text_blocks(batch.column(text_col)):
                scores = own.scores(texts)
                part = batch.slice(first, len(texts))
                more = [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*batch.schema.names, score_col, predicted_col])

    return docs.mapInArrow(run, schema)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score under threshold; the others go. All labels teach.

    Null texts count as empty and have the score of an empty text. Rows that
    repeat, and nulls in other columns, are kept as they are; columns may have
    any names besides doc_id and text. Without labels of both classes every text
    has the same score. No rows: none.
    """
    score, predicted = fresh(docs, "score", "predicted")
    scored = score_toxicity(docs, learn_toxicity(docs, labels), score_col=score, predicted_col=predicted, threshold=threshold)
    return scored.where(F.col(predicted) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out(F.col("doc_id"))
    model = learn_toxicity(docs.where(~held), labels.where(~held))
    return score_toxicity(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
