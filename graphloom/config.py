"""Parameters that change query results."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType


@dataclass(frozen=True)
class Config:
    seeds: int = 5
    seed_cap: int = 6
    gap: float = 0.5
    max_hops: int = 2
    node_budget: int = 60
    hub_percentile: int = 99
    hub_floor: int = 50
    alpha: float = 0.5
    beta: float = 0.3
    gamma: float = 0.2
    w1: float = 1.0
    w2: float = 1.0
    w3: float = 1.0
    w4: float = 1.0
    w5: float = 3.0
    half_life_days: float = 14.0
    dup_cosine: float = 0.9
    relevance_floor: float = 0.65
    conflict_cosine: float = 0.85
    maturity_k: int = 3
    maturity_confirm: float = 1.0
    survival_floor: int = 0
    proposed_ttl: int = 30
    query_budget: int = 4000
    max_drift_lines: int = 4
    manifest_titles: int = 15
    hook_budget: int = 800
    pinned_budget: int = 800
    obligation_share: float = 0.35
    signal_share: float = 0.5
    family_shares: Mapping[str, float] = field(default_factory=lambda: MappingProxyType({"intent": 0.25, "plan": 0.15, "structure": 0.30, "memory": 0.30}))
    max_signal_lines: int = 200
    max_governing: int = 60


DEFAULTS = Config()
