"""Scoring settings, checked on the driver before a job starts."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScoringSettings:
    # fixed values: default settings
    similarity_high: float = 0.95
    similarity_low: float = 0.90
    partial_credit: float = 0.25
    mrc_confidence_threshold: float = 0.8

    def check(self) -> ScoringSettings:
        """Raise unless 0 < low < high <= 1 and both shares are in [0, 1]."""
        if not 0 < self.similarity_low < self.similarity_high <= 1:
            raise ValueError("need 0 < similarity_low < similarity_high <= 1")
        for name in ("partial_credit", "mrc_confidence_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be in [0, 1]")
        return self
