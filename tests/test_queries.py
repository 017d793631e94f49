"""Queries against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import rows

from ledgerloom.plans import queries as Q

CHOSEN = [
    "scan_settled", "accepted_proofs", "tenant_filter", "masked_reference", "unique_transactions", "join_ref_confusable", "join_ref_suffix", "join_time_band",
    "join_amount_probe", "blocking_union_top25", "rank_margin", "decide_core", "amount_semantics", "nav_tally", "earliest_alloc", "alloc_conflict", "proof_conflict",
    "idf_scoring", "parse_amounts", "parse_timestamps", "normalize_phones", "money_display", "normalize_references", "normalize_names", "decay_and_hours",
    "ranking_duplicates", "list_filter", "smart_resize", "extract_claims", "missing_orders", "amount_probes", "jaro_winkler", "extraction_accuracy", "idempotent_replay", "attempts_window", "plateau", "readings_in_utc", "field_validity", "persisted_claims", "category_counts", "policy_sweep_core", "rank_margin_whole", "allocation_problems",
    "join_name_key", "candidate_provenance", "ladder_name", "decide_full", "approve_first_wins", "api_results", "stored_contents",
]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(name, spark, sf, duck):
    got, want = Q.QUERIES[name](spark, sf).toPandas(), duck.sql(Q.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_imports_and_lists(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "decide_full" in entry.queries()
