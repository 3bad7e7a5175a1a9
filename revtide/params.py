"""Scoring, split and rollback parameters, passed to operators."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ScoringParams:
    beta: float = 0.5
    severity_weights: dict = field(default_factory=lambda: {"important": 3.0, "pre_existing": 1.0, "nit": 0.5})
    language_weights: dict = field(default_factory=lambda: {"python": 0.45, "typescript": 0.25, "go": 0.20, "rust": 0.10})
    valid_unlabeled_credit: float = 0.5
    max_neutral_vu_per_round: int = 3
    vu_min_evidence: int = 3


@dataclass(frozen=True)
class SplitParams:
    train: float = 0.6
    validation: float = 0.2
    min_validation: int = 30
    private_share: float = 0.5
    private_salt: str = "private"
    screen_salt: str = "screen"
    screen_fraction: float = 0.2
