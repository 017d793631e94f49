from __future__ import annotations

import math
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import packing as P
from ledgerloom.llm.tokens import UnitEncoder, default_tokenizer_path

ENC = UnitEncoder(default_tokenizer_path())


def check(rows, docs, length):
    want = {}
    for doc, text in docs:
        ids = np.frombuffer(ENC.plain(text or "") + b"\0\0\0\0", "<u4")
        for k in range(0, len(ids), length):
            part = ids[k : k + length]
            key = (doc, k // length, k, len(part), zlib.crc32(part.tobytes()))
            want[key] = want.get(key, 0) + 1
    got = {}
    bins = {}
    for r in rows:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        got[key] = got.get(key, 0) + 1
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= length
    return len(bins)


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = P.op10_best_fit_packing(spark, sf).collect()
    n = check(rows, docs, 2048)
    assert n <= math.ceil(sum(r["length"] for r in rows) / 2048) * 1.1


def test_odd_rows_and_several_tasks(spark):
    docs = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (None, "x y z"), (4, "w " * 500), (4, "w " * 500)] + [(9, "same text")] * 40
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS task", "2 AS mark", "3 AS length")
    for per in (10**9, 200):
        check(P.pack(P.token_pieces(df, length=64), length=64, open_bins=3, tokens_per_task=per).collect(), docs, 64)
    assert P.pack_documents(df.limit(0)).count() == 0


def test_unit_encoder_equals_the_tokenizer():
    assert ENC.by_unit
    texts = ["A.b'S it's don't ÀÉ…. “x” ß. ñ, İI Σς ΣΑΣ.", "x\x1cy z\x85w\xa0v", "é. Å!", "日本語. 123,4", "a\x00b", "<|startoftext|>", "K… a…. ẞ ǅ", "'s 't'", "é É. ́x"]
    assert ENC.encode_batch(texts) == [ENC.plain(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5))
def test_unit_encoder_on_any_text(texts):
    assert ENC.encode_batch(texts) == [ENC.plain(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=200), st.integers(1, 5))
def test_best_fit_never_overflows(sizes, open_bins):
    fit, used = P.BestFit(16, open_bins), {}
    for s in sizes:
        b, at = fit.place(s)
        assert used.get(b, 0) == at
        used[b] = at + s
        assert used[b] <= 16 and fit.open <= open_bins
