"""Forward scenarios: carry the latest year forward and scale it.

Every scenario is one pass: rows are exploded to the future years, and a CASE picks the
factor of each row. Donor classes are a flag, not separate branches.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fluxbook.functions import masks
from fluxbook.functions.values import columns_except, multiply
from fluxbook.operators.joins import spread_join, unique_lookup
from fluxbook.operators.series import latest_year
from fluxbook.vocabulary import PROJECTION_FAMILIES, PROJECTION_INDEX


@dataclass(frozen=True)
class Ramp:
    """An absolute cut of a multiplier, phased in evenly from ``start`` to ``end``."""

    reduction: float
    start: int
    end: int

    def __post_init__(self):
        if self.end < self.start:
            raise ValueError(f"A ramp ends after it starts, not {self.start}-{self.end}")

    def cut(self, year: Column) -> Column:
        share = (year - self.start + 1) / (self.end - self.start + 1)
        return F.lit(self.reduction) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


@dataclass(frozen=True)
class Scenario:
    """``usa`` and ``rest`` are percentage cuts by the target year; ``donors`` says whether
    donors with published multipliers follow those, less ``ramp``. Without ``extend`` the
    rows stay as they are, which puts history next to the scenarios in one pass."""

    name: str
    donors: bool = False
    usa: float = 0
    rest: float = 0
    ramp: Ramp | None = None
    extend: bool = True


# The published scenarios.
SCENARIO_1 = Scenario("scenario 1")
SCENARIO_2 = Scenario("scenario 2", donors=True, usa=60, rest=0)
SCENARIO_3 = Scenario("scenario 3", donors=True, usa=80, rest=10, ramp=Ramp(0.1, 2025, 2027))


# --- multipliers from the projection workbook ---------------------------------------------

_ABBREVIATIONS = (("bl", "bilateral"), ("ml", "multilateral"), ("ag", "agriculture"), ("_value", ""))


def clean_column_name(name: str) -> str:
    """Snake-case header without parenthesised notes, abbreviations spelled out."""
    name = re.sub(r"\(.*?\)", "", name.lower().replace(" ", "_")).strip("_")
    for short, full in _ABBREVIATIONS:
        name = name.replace(short, full)
    return name


def clean_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_column_name(c) for c in df.columns])


def select_family(df: DataFrame, family: str) -> DataFrame:
    """Index columns and one indicator family, with the family prefix taken off.

    A column named like the family itself is the realistic case, unless the family already
    has one of that name.
    """
    columns = [c for c in (*PROJECTION_INDEX, *PROJECTION_FAMILIES[family]) if c in df.columns]
    short = [c.replace(f"{family}_", "") for c in columns]
    if "realistic" not in short:
        short = ["realistic" if c == family else c for c in short]
    return df.select(*[F.col(c).alias(s) for c, s in zip(columns, short)])


def multipliers(projections: DataFrame, deflators: DataFrame, base_year: int = 2023) -> DataFrame:
    """Deflated level over the donor's own base-year level, per (year, iso_code, donor)."""
    rates = unique_lookup(deflators.where("year is not null and iso_code is not null"), ["year", "iso_code"], "usd_usd_deflator")
    level = spread_join(projections, rates, ["year", "iso_code"]).withColumn("level", F.col("realistic") * F.col("usd_usd_deflator"))
    base = F.max(F.when(F.col("year") == base_year, F.col("level"))).over(W.partitionBy("iso_code"))
    return (
        level.withColumn("realistic_multiplier", F.try_divide("level", base))
        .dropna(subset=["realistic_multiplier"])
        .select("year", "iso_code", "donor", "realistic_multiplier")
    )


def ramp_multiplier(df: DataFrame, reduction: float, start_year: int, end_year: int,
                    multiplier: str = "realistic_multiplier",
                    output: str = "realistic_multiplier_reduced") -> DataFrame:
    ramp = Ramp(reduction, start_year, end_year)
    return df.withColumn(output, F.col(multiplier) - ramp.cut(F.col("year")))


# --- carrying the latest year forward -----------------------------------------------------

def extend_year(df: DataFrame, year: int = 2023, to: int = 2024) -> DataFrame:
    """Repeat the rows of one year as another year."""
    years = F.when(F.col("year") == year, F.array(F.lit(year), F.lit(to))).otherwise(F.array("year"))
    return df.withColumn("year", F.explode(years)).select(*df.columns)


def _years_ahead(latest: Column, target_year: int) -> Column:
    """The row's own year, plus the years up to the target for rows of the latest year."""
    # sequence() counts down when its end lies before its start, so the guard is needed.
    ahead = (F.col("year") == latest) & (latest < target_year)
    return F.when(ahead, F.sequence(latest, F.lit(target_year))).otherwise(F.array("year"))


def carry_forward(df: DataFrame, target_year: int, latest: Column | int | None = None) -> DataFrame:
    """Copy the latest year's rows to each year up to the target; adds ``__latest``."""
    latest = latest_year(df) if latest is None else latest
    latest = F.lit(latest) if isinstance(latest, int) else latest
    rows = df.withColumn("__latest", latest)
    return rows.withColumn("year", F.explode(_years_ahead(F.col("__latest"), target_year)))


def _linear_factor(percent: float | Column, target_year: int) -> Column:
    """1 in the past, then a straight line down to 1 - percent/100 in the target year."""
    steps = F.try_divide(F.col("year") - F.col("__latest"), target_year - F.col("__latest"))
    percent = percent if isinstance(percent, Column) else F.lit(float(percent))
    return F.when(F.col("year") > F.col("__latest"), 1 - (percent / 100) * steps).otherwise(F.lit(1.0))


def project_linear(df: DataFrame, version: str | None, reduce_by: float = 0,
                   target_year: int = 2027, latest: int | None = None) -> DataFrame:
    """Carry forward and cut the reducible rows linearly; ``version=None`` cuts all rows."""
    factor = _linear_factor(reduce_by, target_year)
    if version is not None:
        factor = F.when(masks.reducible(version), factor).otherwise(F.lit(1.0))
    return carry_forward(df, target_year, latest).transform(multiply, factor).select(*df.columns)


def project_with_multiplier(df: DataFrame, factors: DataFrame, version: str | None,
                            multiplier: str = "realistic_multiplier", target_year: int = 2027,
                            latest: int | None = None) -> DataFrame:
    """Carry forward and multiply reducible rows of every year by their joined multiplier.

    Without a multiplier a row keeps its value. The multiplier column stays in the result.
    """
    ahead = carry_forward(df, target_year, latest)
    joined = spread_join(ahead, factors.select("iso_code", "year", multiplier), ["iso_code", "year"])
    factor = F.coalesce(multiplier, F.lit(1.0))
    if version is not None:
        factor = F.when(masks.reducible(version), factor).otherwise(F.lit(1.0))
    return joined.transform(multiply, factor).select(*df.columns, multiplier)


def project_scenarios(df: DataFrame, factors: DataFrame, scenarios: Sequence[Scenario],
                      version: str | None, target_year: int = 2027, usa: str = "USA",
                      latest: Column | None = None) -> DataFrame:
    """All scenarios in one pass over ``df``, which needs an iso_code; adds ``scenario``.

    Donors with multipliers, the USA and the rest are three classes. By default each class
    carries its own latest year forward; a caller whose rows are all of one year passes
    ``latest`` and saves the scan for the maxima.
    """
    # All a donor has, in one row: that it has any makes it covered, and each row finds its year's.
    donors = factors.groupBy("iso_code").agg(
        F.collect_list(F.struct("year", F.col("realistic_multiplier").alias("m"))).alias("__years")
    )
    classed = spread_join(df, donors, ["iso_code"]).withColumn(
        "__class",
        F.when(F.col("__years").isNotNull(), "covered").when(F.col("iso_code") == usa, "usa").otherwise("rest"),
    )
    if latest is not None:
        dated = classed.withColumns({"__own": latest, "__all": latest})
    else:
        # At most three rows, one per class; the overall maximum comes from them. As in
        # latest_year, the value rides along so that the shuffle below is shared.
        own = F.max(F.struct("year", "value"))["year"]
        maxima = classed.groupBy("__class").agg(own.alias("__own")).withColumn(
            "__all", F.max("__own").over(W.partitionBy(F.lit(0)))
        )
        dated = classed.join(F.broadcast(maxima), "__class")

    def per_scenario(value):
        return F.coalesce(*[F.when(F.col("scenario") == s.name, value(s)) for s in scenarios])

    year = F.col("year")
    start = per_scenario(lambda s: F.col("__own") if s.donors else F.col("__all"))
    years = per_scenario(lambda s: _years_ahead(F.col("__latest"), target_year) if s.extend else F.array(year))
    rows = (
        dated.withColumn("scenario", F.explode(F.array(*[F.lit(s.name) for s in scenarios])))
        .withColumn("__latest", start)
        .withColumn("year", F.explode(years))
    )
    # Only covered donors in donor scenarios take a multiplier, at most one per year and donor
    # name; all other rows, and years without one, pass with NULL.
    takes = per_scenario(lambda s: F.lit(s.donors)) & (F.col("__class") == "covered")
    own_years = F.transform(F.filter("__years", lambda y: y["year"] == year), lambda y: y["m"])
    rows = rows.withColumn("__m", F.explode_outer(F.when(takes, own_years)))

    def factor_of(s: Scenario) -> Column:
        if not s.extend:
            return F.lit(1.0)
        if not s.donors:
            return _linear_factor(s.rest, target_year)
        own = F.col("__m") - s.ramp.cut(year) if s.ramp else F.col("__m")
        return (
            F.when(F.col("__class") == "covered", F.coalesce(own, F.lit(1.0)))
            .when(F.col("__class") == "usa", _linear_factor(s.usa, target_year))
            .otherwise(_linear_factor(s.rest, target_year))
        )

    factor = per_scenario(factor_of)
    if version is not None:
        factor = F.when(masks.reducible(version), factor).otherwise(F.lit(1.0))
    return rows.transform(multiply, factor).select(*columns_except(df, "scenario"), "scenario")
