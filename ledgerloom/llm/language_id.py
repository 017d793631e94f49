"""Language identification with bit-sliced Bloom filters of character n-grams.

Every slot of the filter holds a word of bits, one for each language. The words
at an n-gram's slots, ANDed, are the set of languages that contain the n-gram.
A text's n-grams are counted for each language, the counts are corrected for the
filter's false positives, and the largest decides.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import fresh, table
from .ngrams import code_points, letter_table, mix64
from .packing import text_blocks

#: n-grams of letters, with a space at the word's ends.
SIZES = (2, 3, 4)
HASHES = 3
#: A language holds an n-gram with at least MIN_SHARE of its n-grams of that size
#: (so at most 1 / MIN_SHARE for each size), and at least RATIO of the largest share of any language.
MIN_SHARE, RATIO = 2e-5, 0.25
#: The classifier is fitted on about so many distinct labelled texts of each language, chosen by hash.
SAMPLE_DOCS = 2_000
#: keep_known's least score: known languages score 0.49 or more on check_s (51,282 documents), others 0.43 or less in samples.
MIN_KNOWN = 0.45
LANGUAGES_PER_WORD = 64
BITS_PER_GRAM = 16


def grams(texts: list[str], sizes=SIZES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, hashes, text numbers) of every n-gram without a space inside, and with a letter or its word's end."""
    flat, starts = code_points(texts)
    letter = letter_table()[flat].astype(bool)
    code = np.where(letter, flat, 32).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    for n in sizes:
        m = len(code) - n + 1
        if m <= 0:
            continue
        ok = np.ones(m, bool)
        for k in range(1, n - 1):
            ok &= letter[k : k + m]
        # both ends may be a space, but a gram of two needs one letter, and no gram crosses into the next text
        ok &= letter[:m] | letter[n - 1 : n - 1 + m]
        at = np.flatnonzero(ok)
        at = at[at < starts[-1]]
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[at + k]
        yield n, mix64(h), owner[at]


class Filters:
    """Bit-sliced Bloom filters: slots[w][i] has the bits of languages 64w to 64w+63."""

    def __init__(self, languages: list[str], members: list[np.ndarray], hashes: int = HASHES):
        self.languages, self.hashes = languages, hashes
        most = max([len(x) for x in members], default=0)
        self.size = 1 << max(10, int(np.ceil(np.log2(max(1, most) * BITS_PER_GRAM))))
        words = max(1, -(-len(languages) // LANGUAGES_PER_WORD))
        self.slots = np.zeros((words, self.size), np.uint64)
        for i, x in enumerate(members):
            bit = np.uint64(1) << np.uint64(i % LANGUAGES_PER_WORD)
            for k in range(hashes):
                self.slots[i // LANGUAGES_PER_WORD][self.slot(x, k)] |= bit
        fill = [float(np.mean((self.slots[i // LANGUAGES_PER_WORD] >> np.uint64(i % LANGUAGES_PER_WORD)) & np.uint64(1))) for i in range(len(languages))]
        self.false_positive = np.asarray(fill) ** hashes

    def slot(self, h: np.ndarray, k: int) -> np.ndarray:
        """Double hashing on the halves of h; the second is odd."""
        second = (h >> np.uint64(32)) | np.uint64(1)
        return ((h + np.uint64(k) * second) & np.uint64(self.size - 1)).astype(np.int64)

    def masks(self, h: np.ndarray, word: int) -> np.ndarray:
        """The languages of one word that contain each n-gram."""
        out = self.slots[word][self.slot(h, 0)]
        for k in range(1, self.hashes):
            out = out & self.slots[word][self.slot(h, k)]
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts, texts by languages, and each text's number of n-grams."""
        got = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        for _, h, owner in grams(texts):
            total += np.bincount(owner, minlength=len(texts))
            for word in range(len(self.slots)):
                mask = self.masks(h, word)
                for i in range(64 * word, min(64 * word + 64, len(self.languages))):
                    bit = ((mask >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)
                    got[:, i] += np.bincount(owner[bit], minlength=len(texts))
        f = self.false_positive
        return np.maximum(0.0, (got - total[:, None] * f) / np.maximum(1e-9, 1 - f)), total

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language or 'und', score) of each text. Ties go to the language that comes first in code-point order."""
        counts, total = self.counts(texts)
        letters = letter_table()
        names, scores = [], np.zeros(len(texts))
        for i, text in enumerate(texts):
            if not self.languages or not any(letters[ord(c)] for c in text[:64]) and not any(letters[ord(c)] for c in text[64:]):
                names.append("und")
                continue
            best = int(np.argmax(counts[i]))
            names.append(self.languages[best])
            scores[i] = min(1.0, counts[i][best] / total[i]) if total[i] else 0.0
        return names, scores


def _count_grams(sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}

        def add(key, h, c) -> None:
            if key in sums:
                h, c = np.concatenate([sums[key][0], h]), np.concatenate([sums[key][1], c])
                h, back = np.unique(h, return_inverse=True)
                c = np.bincount(back, c).astype(np.int64)
            sums[key] = h, c

        for batch in batches:
            langs = np.asarray(batch.column("lang").to_pylist(), object)
            for first, texts in text_blocks(batch.column("text")):
                own = langs[first : first + len(texts)]
                for n, h, owner in grams(texts, sizes):
                    for lang in set(own):
                        add((lang, n), *np.unique(h[(own == lang)[owner]], return_counts=True))
        for (lang, n), (h, c) in sums.items():
            for at in range(0, len(h), 50_000):
                k = len(h[at : at + 50_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * k), pa.array([n] * k, pa.int32()), pa.array(h[at : at + k].view(np.int64)), pa.array(c[at : at + k], pa.int64())], ["lang", "n", "gram", "c"]
                )

    return run


def learn_filters(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, min_share: float = MIN_SHARE, ratio: float = RATIO) -> Filters:
    """Filters from text and lang of docs. Rows with a null in either teach nothing; no rows: no languages.

    The sample's bound: about ``sample_docs`` distinct texts a language, those
    whose hash is lowest; copies of a text count once. The driver gets at most
    1 / min_share n-grams for each language and size.
    """
    labelled = docs.where("text is not null and lang is not null").select("lang", "text")
    sizes = {r["lang"]: r["c"] for r in docs.where("text is not null and lang is not null").groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("c")).collect()}
    if not sizes:
        return Filters([], [])
    share = F.element_at(F.create_map(*[F.lit(x) for lang, c in sizes.items() for x in (lang, min(1.0, sample_docs / c))]), F.col("lang"))
    chosen = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30)).distinct()
    counted = chosen.mapInArrow(_count_grams(SIZES), "lang string, n int, gram long, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    totals = counted.groupBy("lang", "n").agg(F.sum("c").alias("t"))
    shares = counted.join(F.broadcast(totals), ["lang", "n"]).withColumn("share", F.col("c") / F.col("t"))
    kept = shares.where(F.col("share") >= min_share).select("lang", "n", "gram", "share")
    rows = kept.toPandas()
    best = rows.groupby(["n", "gram"])["share"].transform("max")
    rows = rows[rows["share"] >= ratio * best]
    languages = sorted(sizes)
    return Filters(languages, [np.sort(rows["gram"][rows["lang"] == x].to_numpy(np.int64)).view(np.uint64) for x in languages])


def identify(docs: DataFrame, filters: Filters, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with a language and a score: the share (0 to 1) of the text's n-grams that the language contains.

    Null texts and texts without a letter: 'und', 0. Texts are read whole. Columns
    of docs that have these two names already are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(filters))  # at most a few MB: see MIN_SHARE
    docs = docs.drop(lang_col, score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    cache: dict[str, Filters] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cache.setdefault("model", pickle.loads(shared.value))
        for batch in batches:
            for first, texts in text_blocks(batch.column(text_col)):
                names, scores = model.predict(texts)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names, lang_col, score_col])

    return docs.mapInArrow(run, schema)


def keep_known(docs: DataFrame, min_score: float = MIN_KNOWN) -> DataFrame:
    """Documents with a language: those that are 'und', or of whose n-grams the best language holds under min_score, go.

    Null and empty texts and those without a letter go. Rows that repeat, and
    nulls in other columns, are kept as they are; columns may have any names
    besides text and lang. Without labelled rows every text is 'und'. No rows: none.
    """
    lang, score = fresh(docs, "lang_pred", "score")
    found = identify(docs, learn_filters(docs), lang_col=lang, score_col=score)
    return found.where((F.col(lang) != "und") & (F.col(score) >= min_score)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    filters = learn_filters(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), filters).drop("text")
