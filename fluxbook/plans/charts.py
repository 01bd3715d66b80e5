"""Chart tables. All inputs are report tables, so sorting them is a small job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from fluxbook.functions import masks
from fluxbook.functions.values import half_even
from fluxbook.operators import filters
from fluxbook.operators.joins import add_gni, add_gni_per_capita, add_iso_codes
from fluxbook.operators.reshape import custom_sort, pivot_unique
from fluxbook.operators.totals import union_by_name
from fluxbook.settings import FlowSettings
from fluxbook.vocabulary import FLOW_TYPE_TITLES, INCOME_ORDER, SCENARIO_TITLES

BILLION = 1e9
NET_OF_GNI = "net flows as % of GNI"
GNI_TITLE = "GNI, Atlas method (current US$)"
GNI_PC_TITLE = "GNI per capita, Atlas method (current US$)"
NET_TITLE = "net flows (current US$)"


def _in_units(unit: float) -> Column:
    return half_even(F.col("value").cast("double") / unit, 2)


def _share_of_gni(rows: DataFrame, isos: DataFrame, gni: DataFrame) -> DataFrame:
    share = F.try_divide(F.col("value").cast("double"), F.col("gni")) * 100
    return (
        rows.transform(add_iso_codes, isos, "country", output="entity_code")
        .transform(add_gni, gni)
        .withColumn("value_pct_gni", share)
    )


def _with_titles(df: DataFrame) -> DataFrame:
    return df.withColumn("flow_type", masks.recode("flow_type", FLOW_TYPE_TITLES))


def chart_1(net_flows: DataFrame, settings: FlowSettings, download: bool = False) -> DataFrame:
    """Net flows with and without concessional finance, by country and year."""
    rows = net_flows.where(F.col("indicator_type") == "net_flow")
    wide = pivot_unique(rows, ["year", "country"], "flow_type", list(FLOW_TYPE_TITLES))
    if download:
        wide = wide.withColumnsRenamed({
            "all": "net flows including aid and concessional finance",
            "excluding_concessional": "net flows excluding aid and concessional finance",
        }).withColumn("unit", F.lit("current US$"))
    else:
        wide = wide.withColumnsRenamed({
            "all": "all net flows",
            "excluding_concessional": "net flows excluding concessional finance",
        })
    return custom_sort(wide, "country", settings.chart_order, "year")


def chart_2_order() -> list[Column]:
    return [F.asc_nulls_last("flow_type"), F.asc_nulls_last("gni_pc"), F.asc_nulls_last("country")]


def chart_2(net_flows: DataFrame, isos: DataFrame, gni: DataFrame, gni_pc: DataFrame,
            settings: FlowSettings, download: bool = False, unit: float = BILLION) -> DataFrame:
    """African countries in the latest year: net flows as a share of GNI."""
    wanted = (
        (F.col("indicator_type") == "net_flow") & (F.col("continent") == settings.africa)
        & (F.col("year") == settings.latest_year)
    )
    rows = net_flows.where(wanted).select("year", "country", "income_level", "value", "flow_type")
    table = (
        _share_of_gni(rows, isos, gni)
        .dropna(subset=["value_pct_gni"])
        .transform(add_gni_per_capita, gni_pc)
        .transform(_with_titles)
    )
    if download:
        titles = {"value_pct_gni": NET_OF_GNI, "gni_pc": GNI_PC_TITLE, "value": NET_TITLE, "gni": GNI_TITLE}
        return table.orderBy(*chart_2_order()).withColumnsRenamed(titles)
    return table.withColumn("value", _in_units(unit)).orderBy(*chart_2_order())


def chart_3(inflows: DataFrame, counterpart_types: Iterable[str], settings: FlowSettings,
            download: bool = False) -> DataFrame:
    """Debt inflows by counterpart type."""
    wide = pivot_unique(inflows, ["year", "country"], "counterpart_type", list(counterpart_types))
    if download:
        wide = wide.withColumn("prices", F.lit("current"))
    return custom_sort(wide, "country", settings.chart_order, "year")


def chart_4(averages: DataFrame, counterpart_types: Iterable[str], settings: FlowSettings) -> DataFrame:
    """Average debt service per period. The middle period appears under both codes, so each
    row is emitted once per code it belongs to and the table is pivoted once."""
    early, middle, projected = settings.periods
    codes = F.array_compact(F.array(
        F.when(F.col("period").isin(early, middle), F.concat_ws(" ", "counterpart_type", F.lit("data"))),
        F.when(F.col("period").isin(middle, projected), F.col("counterpart_type")),
    ))
    coded = averages.where(F.col("counterpart_type").isNotNull()).withColumn("code", F.explode(codes))
    labels = [label for t in counterpart_types for label in (t, f"{t} data")]
    wide = pivot_unique(coded, ["country", "period", "counterpart_type"], "code", labels)
    return custom_sort(wide, "country", settings.chart_order, "period", "counterpart_type")


def chart_4_download(averages: DataFrame) -> DataFrame:
    return averages.select("period", "country", "counterpart_type", "prices", "value")


def chart_5(net_flows: DataFrame, scenarios: DataFrame, settings: FlowSettings) -> DataFrame:
    """History and the scenarios, each scenario anchored at the latest year."""
    history = "all net flows"
    lines = F.when(
        F.col("year") == settings.latest_year, F.array(*[F.lit(s) for s in (history, *SCENARIO_TITLES)])
    ).otherwise(F.array(F.lit(history)))
    past = net_flows.where("indicator_type = 'net_flow' and flow_type = 'all'").select(
        "year", "country", "value", F.explode(lines).alias("scenario")
    )
    ahead = scenarios.select("year", "country", F.col("net_flows").alias("value"), "scenario")
    wide = pivot_unique(
        union_by_name(past, ahead), ["year", "country"], "scenario", [history, *SCENARIO_TITLES]
    )
    return custom_sort(wide.withColumnsRenamed(SCENARIO_TITLES), "country", settings.chart_order, "year")


def chart_6(net_flows: DataFrame, isos: DataFrame, gni: DataFrame, settings: FlowSettings,
            download: bool = False, unit: float = BILLION) -> DataFrame:
    """Net flows as a share of GNI in the latest year; countries without GNI stay."""
    wanted = (
        F.col("income_level").isin(*INCOME_ORDER) & (F.col("year") == settings.latest_year)
        & (F.col("indicator_type") == "net_flow")
    )
    table = _share_of_gni(net_flows.where(wanted), isos, gni).transform(_with_titles)
    if download:
        titles = {"value_pct_gni": NET_OF_GNI, "gni": GNI_TITLE, "value": NET_TITLE}
        return table.withColumnsRenamed(titles)
    flagged = filters.flag_negative(table).withColumn("value", _in_units(unit))
    return custom_sort(flagged, "income_level", INCOME_ORDER, "flow_type", "country")
