"""Aggregations and group totals.

``relabel_and_sum`` is the workhorse of the reports: each row is emitted once per total it
belongs to and a single partially-combined aggregation sums everything, instead of one scan
and one union branch per total.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fluxbook.functions import masks
from fluxbook.functions.values import (
    columns_except, missing, nan_to_null, sum_by, sum_by_all_except, total,
)
from fluxbook.vocabulary import DAC_TOTAL, HIGH_INCOME


def union_by_name(*frames: DataFrame) -> DataFrame:
    """UNION ALL aligned by column name; columns missing on one side are NULL there."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


# --- sums over the flow table ------------------------------------------------------------

def prep_flows(df: DataFrame, world: str = "World") -> DataFrame:
    """Drop rows without iso_code, zero values and world counterparts; sum the rest."""
    df = nan_to_null(df, "value")
    kept = df.where(F.col("iso_code").isNotNull() & masks.differs("value", 0) & masks.differs("counterpart_area", world))
    return sum_by_all_except(kept)


def net_flows(df: DataFrame) -> DataFrame:
    return sum_by_all_except(df, "indicator_type").withColumn("indicator_type", F.lit("net_flow"))


def by_country(df: DataFrame) -> DataFrame:
    return sum_by_all_except(df, "counterpart_area", "counterpart_type", "indicator")


def drop_counterpart_area(df: DataFrame) -> DataFrame:
    return sum_by_all_except(df, "counterpart_area")


# --- totals appended to their input ------------------------------------------------------

def append_world_total(df: DataFrame, name: str = "World") -> DataFrame:
    world = sum_by_all_except(df.withColumn("country", F.lit(name)), "income_level", "continent")
    return union_by_name(df, world)


def append_group_totals(df: DataFrame, group_column: str, exclude: Sequence[str] = ()) -> DataFrame:
    """One pseudo-country per group; rows without a group give no total."""
    grouped = df.where(F.col(group_column).isNotNull()).withColumn("country", F.col(group_column))
    return union_by_name(df, sum_by_all_except(grouped, *exclude))


def developing_total(df: DataFrame, name: str = "Developing countries") -> DataFrame:
    """The developing-countries rows at the grain of the input (they replace the input)."""
    labels = {"country": name, "income_level": "All", "continent": "World", "iso_code": "DEV"}
    labels = {c: F.lit(v) for c, v in labels.items() if c in df.columns}
    return sum_by_all_except(df.withColumns(labels))


# --- many totals in one pass -------------------------------------------------------------

Level = tuple[Mapping[str, Column], Column | None]


def relabel(df: DataFrame, levels: Iterable[Level]) -> DataFrame:
    """Emit each row once per level that accepts it, with the level's columns replaced.

    A level is (replacements, condition). The added column ``__level`` numbers the level, so
    that a later sum never merges a country with a total of the same name.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    options = []
    for number, (replace, condition) in enumerate(levels):
        row = F.struct(
            F.lit(number).alias("__level"),
            *[replace[c].cast(kinds[c]).alias(c) if c in replace else c for c in df.columns],
        )
        options.append(row if condition is None else F.when(condition, row))
    return df.select(F.explode(F.array_compact(F.array(*options))).alias("row")).select("row.*")


def relabel_and_sum(df: DataFrame, levels: Iterable[Level], *, drop: Sequence[str] = (),
                    measures: Sequence[str] = ("value",)) -> DataFrame:
    """``relabel``, then sum by everything but the measures and ``drop``."""
    rows = relabel(df.drop(*drop), levels)
    return sum_by(rows, columns_except(rows, *measures), *measures).drop("__level")


def itself() -> Level:
    return {}, None


def developing_level(name: str) -> Level:
    labels = {
        "country": F.lit(name), "income_level": F.lit("All"),
        "continent": F.lit("World"), "iso_code": F.lit("DEV"),
    }
    return labels, None


def with_developing_total(df: DataFrame, name: str, drop: Sequence[str] = ()) -> DataFrame:
    """Input rows and the developing-countries total, both summed to the remaining columns."""
    return relabel_and_sum(df, [itself(), developing_level(name)], drop=drop)


def group_summary(df: DataFrame, groups: Iterable[str], developing: str = "Developing countries") -> DataFrame:
    """Only the named groups: developing total, continents and income levels."""
    blank = missing()
    levels = [
        ({"country": F.lit(developing), "continent": blank, "income_level": blank}, None),
        ({"country": F.col("continent"), "income_level": blank}, F.col("continent").isNotNull()),
        ({"country": F.col("income_level"), "continent": blank}, F.col("income_level").isNotNull()),
    ]
    named = [
        (replace, replace["country"].isin(*groups) if keep is None else keep & replace["country"].isin(*groups))
        for replace, keep in levels
    ]
    own = relabel_and_sum(df, [*named, ({}, F.col("country").isin(*groups))])
    return own


# --- income-level and Africa rows of the reports ------------------------------------------

def _income_rows(df: DataFrame, developing: str) -> DataFrame:
    return df.where(masks.differs("country", developing) & masks.differs("income_level", HIGH_INCOME))


def _report_rows(df: DataFrame, name_from: str, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sums by ``keys`` with ``name_from`` as the country; rows with a NULL key drop out."""
    sums = df.dropna(subset=list(keys)).groupBy(*keys).agg(*[total(m).alias(m) for m in measures])
    if name_from in keys:
        sums = sums.withColumnRenamed(name_from, "country")
    return sums


def _blank(df: DataFrame, like: DataFrame, **fixed: Column) -> DataFrame:
    """Labels of a total row: no income level, no continent, plus ``fixed``."""
    labels = {"income_level": missing(), "continent": missing(), **fixed}
    return df.withColumns({c: v for c, v in labels.items() if c in like.columns or c == "period"})


NET_FLOW_KEYS = ("year", "indicator_type", "flow_type", "prices")


def append_income_levels(df: DataFrame, developing: str = "Developing countries") -> DataFrame:
    """Income-level rows of the net-flow report, per flow type and indicator type."""
    sums = _report_rows(_income_rows(df, developing), "income_level", (*NET_FLOW_KEYS, "income_level"), ["value"])
    return union_by_name(df, _blank(sums, df))


def append_africa(df: DataFrame, africa: str = "Africa") -> DataFrame:
    rows = df.where(F.col("continent") == africa)
    sums = _report_rows(rows, "", NET_FLOW_KEYS, ["value"]).withColumn("country", F.lit(africa))
    return union_by_name(df, _blank(sums, df))


SCENARIO_MEASURES = ("inflows", "outflows")


def append_scenario_income_levels(df: DataFrame, developing: str = "Developing countries") -> DataFrame:
    """Income-level rows of the scenario table, summing inflows and outflows together."""
    keys = ("year", "scenario", "income_level")
    sums = _report_rows(_income_rows(df, developing), "income_level", keys, SCENARIO_MEASURES)
    return union_by_name(df, _blank(sums, df, prices=F.lit("current")))


def append_scenario_africa(df: DataFrame, africa: str = "Africa") -> DataFrame:
    rows = df.where(F.col("continent") == africa)
    sums = _report_rows(rows, "continent", ("year", "scenario", "continent"), SCENARIO_MEASURES)
    return union_by_name(df, _blank(sums, df, prices=F.lit("current")))


def append_counterpart_income_levels(df: DataFrame, developing: str = "Developing countries") -> DataFrame:
    """Income-level rows by counterpart type, for the inflow and the debt-service tables."""
    keys = ("year", "income_level", "counterpart_type")
    sums = _report_rows(_income_rows(df, developing), "income_level", keys, ["value"])
    return union_by_name(_blank(sums, df, prices=F.lit("current"), period=missing()), df)


def append_counterpart_africa(df: DataFrame, africa: str = "Africa") -> DataFrame:
    rows = df.where(F.col("continent") == africa)
    sums = _report_rows(rows, "continent", ("year", "continent", "counterpart_type"), ["value"])
    return union_by_name(_blank(sums, df, prices=F.lit("current"), period=missing()), df)


def append_dac_total(df: DataFrame) -> DataFrame:
    """Donor total as one pseudo-donor; rows with a NULL in any key drop out of the total."""
    df = df.drop("realistic_multiplier")
    labels = {c: F.lit(v) for c, v in DAC_TOTAL.items() if c in df.columns}
    tagged = df.withColumns(labels)
    keys = columns_except(df, "value")
    return union_by_name(sum_by(tagged.dropna(subset=keys), keys), df)
