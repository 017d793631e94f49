"""Operators on claims, ledgers, allocations and proofs."""
