"""Yearly series per iso_code: growth, indices, deflators and extrapolation.

A series holds one row per year, so its window partitions are bounded by the number of
years; all windows of an index share one partitioning and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from fluxbook.functions.values import nan_to_null, scaled_type
from fluxbook.operators.joins import spread_join, unique_lookup
from fluxbook.operators.totals import union_by_name


def in_series() -> WindowSpec:
    return W.partitionBy("iso_code")


def in_order() -> WindowSpec:
    return in_series().orderBy("year")


def so_far() -> WindowSpec:
    return in_order().rowsBetween(W.unboundedPreceding, 0)


def _latest(df: DataFrame) -> DataFrame:
    # The value rides along in the maximum so that both uses of df need the same columns:
    # Spark then computes the shuffle below them once and reuses it.
    return df.agg(F.max(F.struct("year", "value"))["year"].alias("__latest"))


def latest_year(df: DataFrame) -> Column:
    """Largest year of a table as a scalar subquery, so nothing passes through the driver."""
    return _latest(df).scalar()


def keep_latest_year(df: DataFrame) -> DataFrame:
    """Rows of the last year. An equi-join with one row, because a filter on the scalar
    would be pushed below the shuffle and keep it from being shared with the maximum."""
    return df.join(F.broadcast(_latest(df)), F.col("year") == F.col("__latest")).drop("__latest")


def growth_rate(df: DataFrame) -> DataFrame:
    """Change on the previous row, gaps carried forward; rows without a rate drop out."""
    filled = nan_to_null(df, "value").withColumn("value", F.last("value", ignorenulls=True).over(so_far()))
    rate = F.try_divide(F.col("value"), F.lag("value").over(in_order())) - 1
    return filled.withColumn("value", rate).dropna(subset=["value"])


def cumulative_growth(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.product(1 + F.col("value")).over(so_far()))


def rebase(df: DataFrame, base_year: int) -> DataFrame:
    """Divide by the base-year value; NULL where a series has no base year."""
    df = nan_to_null(df, "value")
    base = F.sum(F.when(F.col("year") == base_year, F.col("value"))).over(in_series())
    return df.withColumn("value", F.try_divide(F.col("value"), base))


def growth_index(macro: DataFrame, base_year: int) -> DataFrame:
    """Index of one macro series: growth, cumulated, 1 in the base year."""
    index = macro.transform(growth_rate).transform(cumulative_growth).transform(rebase, base_year)
    return index.select("iso_code", "year", F.col("value").cast("double").alias("value"))


def price_deflator(macro: DataFrame, base_year: int) -> DataFrame:
    return rebase(macro, base_year).select("iso_code", "year", "value")


def exchange_deflator(local: DataFrame, dollars: DataFrame, base_year: int) -> DataFrame:
    """100 x (dollars per local unit) over its base-year value; no base year, no rows."""
    both = local.select("iso_code", "year", F.col("value").alias("lcu")).join(
        dollars.select("iso_code", "year", F.col("value").alias("usd")), ["iso_code", "year"]
    )
    rate = both.select("year", "iso_code", F.try_divide("usd", "lcu").alias("rate"))
    base = F.max(F.when(F.col("year") == base_year, F.struct("rate"))).over(in_series())
    return (
        rate.withColumn("base", base)
        .where("base is not null")
        .select("year", "iso_code", F.try_divide(100 * F.col("rate"), F.col("base.rate")).alias("exchange_deflator"))
    )


def extend_series(df: DataFrame, last_year: int, window: int = 3, mode: str = "published") -> DataFrame:
    """Extend each series to ``last_year`` by its mean yearly difference.

    With m(y) the mean of the ``window`` yearly differences ending at y, year max+k gets
    v(max) + k*m(max). The published figures carry one more m(max-1), which
    ``mode="clean"`` leaves out. An undefined m(max) falls back to m(max-1); without either
    the value is NULL.
    """
    if mode not in ("published", "clean"):
        raise ValueError(f"Unknown mode {mode!r}")
    top, year = F.col("__top"), F.col("year")

    def mean_ending(offset: int) -> Column:
        inside = year.between(top - offset - window + 1, top - offset)
        diff = F.when(inside, F.col("__diff"))
        full = F.count(diff).over(in_series()) == window
        return F.when(full, F.sum(diff).over(in_series()) / window)

    recent = F.when(year >= top - window, F.when(F.col("value").isNotNull(), F.struct("year", "value")))
    step = F.coalesce("__m", "__m_prev")
    extra = F.coalesce("__m_prev", F.lit(0.0)) if mode == "published" else F.lit(0.0)
    ahead = F.col("__year") - top
    future = F.col("__last.value") + extra + ahead * step
    years = F.when((year == top) & (top < last_year), F.sequence(year, F.lit(last_year))).otherwise(F.array(year))
    return (
        df.withColumns({
            "__diff": F.col("value") - F.lag("value").over(in_order()),
            "__top": F.max("year").over(in_series()),
        })
        .withColumns({
            "__m": mean_ending(0),
            "__m_prev": mean_ending(1),
            "__last": F.max(recent).over(in_series()),
        })
        .withColumn("__year", F.explode(years))
        .withColumn("value", F.when(F.col("__year") <= top, F.col("value")).otherwise(future))
        .select(*[F.col("__year").alias("year") if c == "year" else c for c in df.columns])
    )


def future_gni(gni: DataFrame, index: DataFrame, prices: str) -> DataFrame:
    """Level of the last year in ``gni`` times the growth index of each later year."""
    level = keep_latest_year(gni).select("iso_code", F.col("value").alias("level"))
    ahead = index.where(F.col("year") > latest_year(gni))
    grown = (F.col("level") * F.col("value")).alias(f"{prices}_usd_gni")
    return ahead.join(level, "iso_code").select("year", "iso_code", grown)


def _gni_with_future(gni: DataFrame, index: DataFrame, prices: str) -> DataFrame:
    known = gni.select("year", "iso_code", F.col("value").alias(f"{prices}_usd_gni"))
    return union_by_name(known, future_gni(gni, index, prices))


def current_series(gni: DataFrame, nominal_index: DataFrame) -> DataFrame:
    """Current GNI, history and future, with the local-currency deflator where known."""
    deflator = nominal_index.select("year", "iso_code", F.col("value").alias("lcu_lcu_deflator"))
    return _gni_with_future(gni, nominal_index, "current").join(deflator, ["year", "iso_code"], "left")


def year_iso_grid(isos: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """Every year for every iso, by exploding a year sequence rather than by a cross join."""
    years = F.sequence(F.lit(start_year), F.lit(end_year)) if end_year >= start_year else F.array().cast("array<int>")
    return isos.select("iso_code").distinct().select(F.explode(years).alias("year"), "iso_code")


def deflate(df: DataFrame, deflators: DataFrame, *, to_current: bool = False, column: str = "value") -> DataFrame:
    """Constant prices through a base-100 deflator joined on (iso_code, year), or back again.

    ``deflators`` may be for any pair of currencies, see ``currency_deflators``."""
    rates = deflators.select("iso_code", "year", F.col("deflator").alias("__deflator"))
    rate = F.col("__deflator") / 100
    value = F.col(column).cast("double")
    changed = value * rate if to_current else F.try_divide(value, rate)
    deflated = spread_join(df, rates, ["iso_code", "year"])
    return deflated.withColumn(column, changed.cast(scaled_type(df, column))).select(*df.columns)


# --- deflation between currencies ----------------------------------------------------------

#: The country's own currency, and the one that all rates are quoted in.
LOCAL, DOLLAR = "LCU", "USD"


@dataclass(frozen=True)
class Currencies:
    """Amounts of ``source`` currency turned into constant prices of ``target``, or back ``to_current``.

    A currency is ``LOCAL``, ``DOLLAR`` or the iso code of the country whose currency it is.
    """

    source: str = DOLLAR
    target: str = DOLLAR
    to_current: bool = False


def currency_rates(deflators: DataFrame, exchange: DataFrame, base_year: int) -> DataFrame:
    """Per (iso_code, year): ``price``, the price level over the base year's, ``rate``, dollars for a unit of
    the local currency, and ``base_rate``, the same in the base year.

    ``deflators`` has a base-100 ``deflator``, ``exchange`` a ``rate``, one row per iso and year each. The base year is read by a window over
    the series, so both tables meet once. A year without a rate still serves local currency.
    """
    both = unique_lookup(deflators, ["iso_code", "year"], "deflator").join(
        unique_lookup(exchange, ["iso_code", "year"], "rate"), ["iso_code", "year"], "left"
    )
    base = F.max(F.when(F.col("year") == base_year, F.struct(nullable(F.col("deflator")).alias("deflator"), nullable(F.col("rate")).alias("rate")))).over(in_series())
    return both.withColumn("__base", base).select(
        "iso_code", "year", F.try_divide("deflator", F.col("__base.deflator")).alias("price"), "rate", F.col("__base.rate").alias("base_rate")
    )


def nullable(column: Column) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(column.cast("double")), column)


def _of_country(rates: DataFrame, iso: str, column: str) -> DataFrame:
    """One country's rates by year, for amounts in its currency: a row per year."""
    return rates.where(F.col("iso_code") == iso).select(F.col("year").alias("__year"), F.col(column).alias(f"__{iso}_{column}"))


def deflate_between(df: DataFrame, rates: DataFrame, pairs: Sequence[Currencies], column: str = "value") -> DataFrame:
    """Rows of ``df`` once per pair of currencies, with ``source_currency``, ``target_currency``, ``to_current``.

    The way leads through the dollar: an amount of year y is turned into dollars by its currency's
    rate of y and from there into the country's own currency, is divided by the country's price level of y, and
    goes through the dollar into the target currency at the rates of the base year. ``to_current`` goes the
    way back. The rates are looked up once for all pairs; where one is missing the value is NULL.
    """
    joined = spread_join(df, rates.select("iso_code", "year", "price", "rate", "base_rate"), ["iso_code", "year"])
    others = sorted({c for p in pairs for c in (p.source, p.target)} - {LOCAL, DOLLAR})
    for iso in others:
        for own in ("rate", "base_rate"):
            joined = joined.join(F.broadcast(_of_country(rates, iso, own)), F.col("year") == F.col("__year"), "left").drop("__year")

    def dollars(currency: str, own: str) -> Column:
        return F.lit(1.0) if currency == DOLLAR else F.col(own if currency == LOCAL else f"__{currency}_{own}")

    def factor(p: Currencies) -> Column:
        """What one unit of the source currency is worth in constant prices of the target."""
        into = F.lit(1.0) if p.source == LOCAL else F.try_divide(dollars(p.source, "rate"), F.col("rate"))
        out = F.lit(1.0) if p.target == LOCAL else F.try_divide(F.col("base_rate"), dollars(p.target, "base_rate"))
        return F.try_divide(into * out, F.col("price"))

    value = F.col(column).cast("double")
    kind = scaled_type(df, column)
    made = F.array(*[
        F.struct(
            F.lit(p.source).alias("source_currency"), F.lit(p.target).alias("target_currency"), F.lit(p.to_current).alias("to_current"),
            (F.try_divide(value, factor(p)) if p.to_current else value * factor(p)).cast(kind).alias("__made"),
        )
        for p in pairs
    ])
    kept = [F.col("__pair.__made").alias(column) if c == column else F.col(c) for c in df.columns]
    return joined.withColumn("__pair", F.explode(made)).select(*kept, "__pair.source_currency", "__pair.target_currency", "__pair.to_current")


def currency_deflators(rates: DataFrame, pair: Currencies = Currencies()) -> DataFrame:
    """The base-100 deflator of one pair of currencies by (iso_code, year), for ``deflate`` and the flow table."""
    units = rates.select("iso_code", "year", F.lit(100.0).alias("value"))
    current = Currencies(pair.source, pair.target, to_current=True)
    return deflate_between(units, rates, [current]).select("iso_code", "year", F.col("value").alias("deflator"))


def to_constant_prices(df: DataFrame, deflators: DataFrame) -> DataFrame:
    return deflate(df, deflators).withColumn("prices", F.lit("constant"))


def constant_series(gni: DataFrame, real_index: DataFrame, usd_deflators: DataFrame,
                    lcu_deflators: DataFrame, exchange: DataFrame, start_year: int, end_year: int,
                    splice_year: int = 2023) -> DataFrame:
    """Deflator series for constant GNI: published up to the splice year, exchange-derived after."""
    full = _gni_with_future(gni, real_index, "constant")
    grid = year_iso_grid(full, start_year, end_year).withColumn("value", F.lit(100.0))

    def deflated(deflators: DataFrame, name: str) -> DataFrame:
        return deflate(grid, deflators, to_current=True).dropna(subset=["value"]).select(
            "year", "iso_code", F.col("value").alias(name)
        )

    lcu = deflated(lcu_deflators, "lcu_lcu_deflator")
    known = deflated(usd_deflators, "usd_usd_deflator").where(F.col("year") <= splice_year)
    derived = F.try_divide(100 * F.col("lcu_lcu_deflator"), F.col("exchange_deflator"))
    later = (
        lcu.where(F.col("year") > splice_year)
        .join(exchange, ["year", "iso_code"])
        .select("year", "iso_code", derived.alias("usd_usd_deflator"))
    )
    series = (
        union_by_name(known, later)
        .join(lcu, ["year", "iso_code"], "left")
        .join(full, ["year", "iso_code"], "left")
    )
    values = ("usd_usd_deflator", "lcu_lcu_deflator", "constant_usd_gni")
    return series.withColumns({c: F.bround(F.col(c).cast("double"), 4) for c in values})
