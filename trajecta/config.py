"""Run parameters; every threshold of the operators is an argument with these defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from trajecta.functions.constants import WITNESSES


@dataclass(frozen=True)
class Settings:
    first_period: int = 1900
    vintage: int = 2025
    threshold: int = 2000
    groups: int = 5
    labels: tuple[str, ...] = ("Groupe 1", "Groupe 2", "Groupe 3", "Groupe 4", "Groupe 5")
    features: tuple[str, str] = ("peak_period", "strong_width")
    restarts: int = 20
    draws: int = 20
    seed: int = 0
    pivot: int = 2000
    witnesses: tuple[str, ...] = field(default=tuple(WITNESSES))

    def __post_init__(self) -> None:
        if len(self.labels) != self.groups:
            raise ValueError(f"{len(self.labels)} labels for {self.groups} groups")
