"""Row filters, relabels and column tags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fluxbook.functions import masks
from fluxbook.functions.sizes import below_broadcast_threshold
from fluxbook.vocabulary import CHINA_RELABELS, DEBT_KEYS, OTHER_OFFICIAL_DONORS

Members = DataFrame | Iterable


def keep_members(df: DataFrame, column: str, members: Members, extra: Iterable = ()) -> DataFrame:
    """Keep rows whose ``column`` is in a code group.

    A Python collection becomes an ``IN`` list, which reaches the parquet scan. A one-column
    table becomes a left semi join whose strategy Spark picks from the table's measured size.
    """
    if isinstance(members, DataFrame):
        group = members.toDF(column)
        keep = df.join(group, column, "left_semi")
        extra = list(extra)
        if not extra:
            return keep
        # One pass over df for "in table or in list": flag the table hit, then test both.
        flagged = df.join(group.distinct().withColumn("__hit", F.lit(True)), column, "left")
        hit = F.col("__hit").isNotNull() | F.col(column).isin(*extra)
        return flagged.where(hit).select(*df.columns)
    return df.where(F.col(column).isin(*members, *extra))


def assign_indicator(df: DataFrame, indicator: str) -> DataFrame:
    """Key columns and value (those present) tagged with an indicator name."""
    wanted = [c for c in (*DEBT_KEYS, "value") if c in df.columns]
    return df.select(*wanted, F.lit(indicator).alias("indicator"))


def keep_official_donors(df: DataFrame, official: Members) -> DataFrame:
    return keep_members(df, "donor_code", official, OTHER_OFFICIAL_DONORS)


def keep_recipient_group(df: DataFrame, developing: Members) -> DataFrame:
    """Keep recipients that belong to the developing countries and regions group."""
    return keep_members(df, "recipient_code", developing)


def is_no_total(column: str) -> Column:
    return ~F.col(column).contains(", Total")


def drop_totals(df: DataFrame, column: str) -> DataFrame:
    """Drop "..., Total" rows; rows with a NULL name go too."""
    return df.where(is_no_total(column))


def drop_counterpart_totals(df: DataFrame) -> DataFrame:
    return drop_totals(df, "counterpart_area")


def drop_recipient_totals(df: DataFrame) -> DataFrame:
    return drop_totals(df, "country")


def exclude_outlier_countries(df: DataFrame, outliers: Iterable[str]) -> DataFrame:
    return df.where(~masks.is_any("country", outliers))


def assign_grants_indicator(df: DataFrame, bilateral: Members) -> DataFrame:
    """Donors of the bilateral group give ``grants_bilateral``, all others multilateral."""
    if isinstance(bilateral, DataFrame):
        group = bilateral.toDF("donor_code").distinct().withColumn("__bilateral", F.lit(True))
        df = df.join(group, "donor_code", "left")
        hit = F.col("__bilateral").isNotNull()
    else:
        hit = masks.is_any("donor_code", bilateral)
    label = F.when(hit, "grants_bilateral").otherwise("grants_multilateral")
    return df.withColumn("indicator", label).drop("__bilateral")


def add_counterpart_type(df: DataFrame) -> DataFrame:
    return df.withColumn("counterpart_type", masks.counterpart_type())


def split_counterpart(df: DataFrame, china: str = "China") -> DataFrame:
    """Give one counterpart area a counterpart type of its own, named China."""
    own = F.when(F.col("counterpart_area") == china, "China")
    return df.withColumn("counterpart_type", own.otherwise(F.col("counterpart_type")))


def relabel_counterparts(df: DataFrame) -> DataFrame:
    return df.replace(CHINA_RELABELS, subset=["counterpart_type"])


def exclude_grants(df: DataFrame) -> DataFrame:
    return df.where(masks.not_grant())


def exclude_grants_and_concessional(df: DataFrame) -> DataFrame:
    return df.where(masks.not_grant_or_concessional())


def apply_version(df: DataFrame, version: str) -> DataFrame:
    mask = masks.version_mask(version)
    return df if mask is None else df.where(mask)


def drop_empty_values(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["value"]).where(F.col("value") != 0)


def keep_countries_with_outflows(df: DataFrame, *also_by: str) -> DataFrame:
    """Keep (year, country) pairs that have an outflow row, in one pass over ``df``.

    For aggregated flows only: a pair then holds a few rows per indicator, so its window
    frame stays small. Fact-grained input goes through ``semi_join_outflows``.
    """
    pair = W.partitionBy(*also_by, "year", "country")
    has_outflow = F.max(F.coalesce(F.col("indicator_type") == "outflow", F.lit(False))).over(pair)
    return df.withColumn("__keep", has_outflow).where("__keep and year is not null").drop("__keep")


def semi_join_outflows(df: DataFrame, countries: DataFrame | None = None, years: int = 100) -> DataFrame:
    """The same rule for fact-grained input: a semi join on the distinct outflow pairs.

    There are at most as many pairs as countries times years. Where the table of ``countries``,
    times ``years``, is under the broadcast threshold, the pairs are broadcast and the facts stay
    where they are; else, and without that table, the join is left to Spark. Distinct pairs are
    combined map-side, so a pair holding most of the rows costs nothing extra.
    """
    pairs = (
        df.where(F.col("indicator_type") == "outflow")
        .select(F.col("year").alias("__year"), F.col("country").alias("__country"))
        .distinct()
    )
    if countries is not None and below_broadcast_threshold(countries, years):
        pairs = F.broadcast(pairs)
    match = (F.col("year") == F.col("__year")) & F.col("country").eqNullSafe(F.col("__country"))
    return df.join(pairs, match, "left_semi")


def flag_negative(df: DataFrame, column: str = "value") -> DataFrame:
    """Colour flag from the unrounded value, so that a rounded -0.0 keeps its flag."""
    return df.withColumn("color", F.when(F.col(column) < 0, "highlight").otherwise(""))


def null_before(df: DataFrame, year: int, *columns: str) -> DataFrame:
    """Blank scenario columns in the historic years."""
    return df.withColumns({c: F.when(F.col("year") >= year, F.col(c)) for c in columns})
