"""Averages over fixed periods."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from fluxbook.functions.values import half_even, sum_by

Periods = Mapping[str, tuple[int, int, int]]


def period_of(year: str, periods: Periods) -> Column:
    """Label of the period a year falls in, NULL outside all of them (last match wins)."""
    hits = [F.when(F.col(year).between(a, b), F.lit(name)) for name, (a, b, _) in periods.items()]
    return F.coalesce(*reversed(hits))


def average_by_period(df: DataFrame, periods: Periods, by_counterpart_type: bool = True) -> DataFrame:
    """Yearly average per period: the sum over the fixed period length, to 2 digits.

    The divisor is the period's length even where years are missing.
    """
    keys = ["period", "country", "continent", "income_level", "prices"]
    if by_counterpart_type:
        keys.append("counterpart_type")
    bucketed = df.withColumn("period", period_of("year", periods)).where("period is not null")
    sums = sum_by(bucketed, keys)
    length = F.coalesce(*[F.when(F.col("period") == p, F.lit(n)) for p, (_, _, n) in periods.items()])
    return sums.withColumn("value", half_even(F.col("value") / length, 2))
