from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import rows

from ledgerloom.llm import topk as K


def brute(vectors, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j) for j, c in ok if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_query(spark, sf, duck):
    assert rows(K.op7_top_k(spark, sf).toPandas()) == rows(duck.sql(K.OP7_SQL).df())


@pytest.mark.parametrize("sizes", [(2048, 8192), (7, 9)])
def test_odd_vectors_and_ties(spark, monkeypatch, sizes):
    monkeypatch.setattr(K, "BLOCK", sizes[0])
    monkeypatch.setattr(K, "QUERY_BLOCK", sizes[1])
    monkeypatch.setattr(K, "GROUP_BYTES", 100 * sizes[0])
    rng = np.random.default_rng(3)
    data = [(i, [float(np.float32(x)) for x in rng.normal(0, 1 + i % 7, 5)]) for i in range(120)]
    data += [(200 + i, [1.0, 2.0]) for i in range(45)] + [(300, None), (301, []), (302, [1.0, None]), (303, [float("nan")]), (304, [float("inf")]), (None, [1.0]), (320, [0.0] * 5), (340, data[3][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "'c' AS id", "'c' AS v", "'c' AS norm")
    v = K.whole_vectors(df, "vec_id", "embedding")
    got = K.top_k(v, v.where("id % 20 = 0"))
    assert sorted(map(tuple, got.collect())) == brute(data, 20)
    assert K.top_k(v.limit(0), v.limit(0)).count() == 0
    none = K.whole_vectors(spark.createDataFrame([(20, []), (21, []), (22, None)], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert sorted(map(tuple, K.top_k(none, none.where("id = 20")).collect())) == [(20, 1, 21, 0)]
    assert K.top_k(v.where("id = 0"), v.where("id = 0")).count() == 0
