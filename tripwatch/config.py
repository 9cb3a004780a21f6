"""Settings of a detector, with their defaults and limits."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    pattern_decay: int = -1
    pattern_threshold: int = -1
    pattern_resolution: int = -1
    alpha_critical: float = 0.01
    alpha_suspicious: float = 0.05
    evaluate_structure: bool = True
    evaluate_data: bool = True
    evaluate_timestamps: bool = False
    grace_period: int = 100
    samplesize: int = 50
    samplegap: int = 10
    match_cwa: bool = False
    match_exact: bool = False
    pi_tolerance: float = 0.1
    report_level: int = 3
    seed: int = 0
    resamples: int = 1000

    def __post_init__(self) -> None:
        good = 0 < self.alpha_critical < 1 and 0 < self.alpha_suspicious < 1 and self.grace_period > 0 and self.samplesize > 1
        if not (good and self.samplegap >= 0 and self.pi_tolerance >= 0 and 0 <= self.report_level <= 5):
            raise ValueError(f"settings out of range: {self}")

    @classmethod
    def from_toml(cls, path: str, section: str | None = None) -> Settings:
        """Settings of a TOML file, or of one of its tables; names that are none of ours are left out."""
        found = tomllib.loads(Path(path).read_text())
        found = found.get(section, {}) if section else found
        return cls(**{f.name: found[f.name] for f in fields(cls) if f.name in found})
