"""Analysis settings shared by the plans. Defaults are the published analysis."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from fluxbook import vocabulary as v


@dataclass(frozen=True)
class FlowSettings:
    first_year: int = 2000
    last_year: int = 2024
    service_projection_years: int = 4
    price_base_year: int = 2024
    latest_year: int = 2023
    last_service_year: int = 2027
    target_year: int = 2027
    outliers: tuple[str, ...] = ("China", "Ukraine", "Russia")
    china: str = "China"
    world: str = "World"
    developing: str = "Developing countries"
    africa: str = "Africa"
    usa_iso: str = "USA"
    groups: Mapping[str, int] = field(default_factory=lambda: v.COUNTRY_GROUPS)
    periods: Mapping[str, tuple[int, int, int]] = field(default_factory=lambda: v.AVERAGE_PERIODS)

    @property
    def chart_order(self) -> tuple[str, ...]:
        """Row order of the chart tables: groups first, then everything else by name."""
        return (self.developing, self.africa, *reversed(v.INCOME_ORDER))
