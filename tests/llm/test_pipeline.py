from __future__ import annotations

import pytest

import corpus_pipeline as C
from ledgerloom.llm.base import Tables


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables, before = Tables(spark), None
    for name, stage in C.STAGES[:-1]:
        out = tables.write(stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        ids, kept = {r[0] for r in docs.select("doc_id").collect()}, {r[0] for r in out.select("doc_id").collect()}
        assert kept <= ids and len(kept) >= 0.7 * len(ids) - (name == "mixing") * len(ids)
        before, docs = docs, out
    pieces = C.packing(spark, docs, sf).collect()
    assert {r["doc_id"] for r in pieces} == {r[0] for r in docs.select("doc_id").collect()} and before is not None


@pytest.mark.parametrize("k", range(5))
def test_stages_take_no_rows(spark, sf, k):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert C.STAGES[k][1](spark, docs, sf).count() == 0
