"""Names of the two business units; every label and table suffix follows from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from cellarbook.fixed_values import BRANCH_UNITS


@dataclass(frozen=True)
class Site:
    """`unit_a` and `unit_b` as the till writes them; ledgers write unit B in lower case."""

    unit_a: str = "Alpha"
    unit_b: str = "beTa"
    branches: dict[int, str] = field(default_factory=lambda: dict(BRANCH_UNITS))

    @property
    def a(self) -> str:
        return self.unit_a.lower()

    @property
    def b(self) -> str:
        return self.unit_b.lower()

    def unit_of_branch(self) -> dict[int, str]:
        names = {"a": self.unit_a, "b": self.unit_b}
        return {branch: names[unit] for branch, unit in self.branches.items()}
