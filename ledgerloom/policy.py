"""The one value that holds every threshold of a decision."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields, replace

ENGINE_VERSION = "loom-engine-1.0.0"
RULESET_VERSION = "loom-rules-1.0.0"


@dataclass(frozen=True, kw_only=True)
class Policy:
    """Fixed default values; ``validate`` refuses contradictory ones."""

    policy_id: str = "loom-policy-1.0.0"
    time_window_s: int = 86_400
    max_candidates: int = 25
    blocking_idf_floor: float = 0.15
    ts_offset_s: float = 120.0
    ts_scale_s: float = 900.0
    ts_offset_s_date_inferred: float = 21_600.0
    ts_scale_s_date_inferred: float = 43_200.0
    hour_artifact_tol_s: float = 90.0
    ts_sim_tight_t: float = 0.98
    ts_sim_close_t: float = 0.80
    ts_sim_loose_t: float = 0.40
    name_strong_t: float = 0.92
    name_initials_t: float = 0.80
    name_pair_min_t: float = 0.70
    name_common_idf_t: float = 0.30
    name_idf_floor: float = 0.15
    ref_min_partial_len: int = 4
    tau_accept: float = 0.82
    tau_reject: float = 0.45
    tau_margin: float = 0.10
    tau_ambiguous: float = 0.45
    missing_evidence_penalty: float = 0.50
    w_reference: float = 1.0
    w_amount: float = 1.0
    w_timestamp: float = 0.8
    w_sender_name: float = 0.6
    amount_tolerance_minor: int = 0
    inflation_material_minor: int = 5_000
    inflation_material_pct: float = 0.01
    overpayment_material_minor: int = 20_000
    overpayment_material_pct: float = 1.0
    min_field_confidence: float = 0.75
    tamper_signal_limit: int = 1

    def __post_init__(self) -> None:
        self.validate()

    def validate(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(f"policy: {what}")

        need(bool(self.policy_id), "policy_id is empty")
        need(self.time_window_s > 0 and self.max_candidates > 0, "window and cap must be positive")
        for name in ("tau_accept", "tau_reject", "tau_margin", "tau_ambiguous", "missing_evidence_penalty", "min_field_confidence",
                     "blocking_idf_floor", "name_idf_floor", "name_common_idf_t", "ts_sim_tight_t", "ts_sim_close_t", "ts_sim_loose_t",
                     "name_strong_t", "name_initials_t", "name_pair_min_t"):
            need(0.0 <= getattr(self, name) <= 1.0, f"{name} is outside 0..1")
        need(self.tau_reject <= self.tau_accept, "tau_reject is above tau_accept")
        need(self.ts_sim_tight_t >= self.ts_sim_close_t >= self.ts_sim_loose_t, "time cut-points must fall")
        need(self.name_strong_t >= self.name_initials_t >= self.name_pair_min_t, "name cut-points must fall")
        need(min(self.ts_offset_s, self.ts_offset_s_date_inferred, self.hour_artifact_tol_s) >= 0, "offsets must not be negative")
        need(min(self.ts_scale_s, self.ts_scale_s_date_inferred) > 0, "scales must be positive")
        weights = (self.w_reference, self.w_amount, self.w_timestamp, self.w_sender_name)
        need(min(weights) >= 0 and sum(weights) > 0, "weights must not be negative, nor all zero")
        need(self.amount_tolerance_minor >= 0 and self.inflation_material_minor >= 0 and self.overpayment_material_minor >= 0, "amounts must not be negative")
        need(self.inflation_material_pct >= 0 and self.overpayment_material_pct >= 0, "shares must not be negative")
        need(self.ref_min_partial_len >= 1 and self.tamper_signal_limit >= 0, "lengths and limits")

    def fingerprint(self) -> str:
        """First 16 hex digits of SHA-256 over the sorted compact JSON of all values."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]

    def with_(self, **changes) -> Policy:
        return replace(self, **changes)

    @classmethod
    def knobs(cls) -> list[str]:
        return [f.name for f in fields(cls) if f.name != "policy_id"]


DEFAULT = Policy()
