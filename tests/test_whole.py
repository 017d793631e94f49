"""Queries that return all of what their shorter forms cut, against their SQL."""

from __future__ import annotations

import os

import duckdb
from conftest import rows

from ledgerloom.plans import queries as Q

SF = "/root/testdata/sf0.01"  # sf0.001 has two candidates a claim at most


def same_as_sql(spark, name):
    c = duckdb.connect()
    for x in os.listdir(SF):
        c.execute(f"CREATE VIEW {x.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{x}'")
    got = Q.QUERIES[name](spark, SF).toPandas()
    assert rows(got) == rows(c.sql(Q.ORACLE[name]).df())
    return got


def test_rank_margin_whole(spark):
    got = same_as_sql(spark, "rank_margin_whole")
    per = got.groupby("claim_id")["rnk"].agg(["max", "count"])
    assert per["max"].max() > 3 and (per["max"] == per["count"]).all() and (per["max"].to_numpy() == got.groupby("claim_id")["n_candidates"].max().to_numpy()).all()


def test_allocation_problems(spark):
    assert set(same_as_sql(spark, "allocation_problems")["problem"]) == {"MISSING", "EXTRA", "DUPLICATE"}
