"""Report tables: net flows, historical inflows, debt service.

Each report reads the flow table once. The flows are first summed to the columns the report
needs, which shrinks them to a few rows per country and year; only then come the outflow
rule, the group totals and the final sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fluxbook.functions import masks
from fluxbook.functions.values import missing, sum_by
from fluxbook.operators import filters, totals
from fluxbook.settings import FlowSettings
from fluxbook.vocabulary import GRANT_INDICATORS, HIGH_INCOME, OUTPUT_GROUPER


def net_flows_by_country(flows: DataFrame, settings: FlowSettings, version: str = "total",
                         as_net_flows: bool = True) -> DataFrame:
    """Flows by country and for the developing countries together."""
    rows = flows.where(F.col("year") <= settings.latest_year)
    rows = filters.exclude_outlier_countries(rows, settings.outliers).transform(filters.apply_version, version)
    summed = sum_by(rows, OUTPUT_GROUPER).transform(filters.keep_countries_with_outflows)
    if as_net_flows:
        summed = summed.withColumn("indicator_type", F.lit("net_flow"))
    return totals.with_developing_total(summed, settings.developing)


def net_flows_report(flows: DataFrame, settings: FlowSettings) -> DataFrame:
    """Inflows, outflows and net flows, with and without concessional finance, by country,
    income level, for Africa and for the developing countries together."""
    rows = flows.where(F.col("year") <= settings.latest_year)
    rows = filters.exclude_outlier_countries(rows, settings.outliers)
    marked = rows.withColumn("__market", F.coalesce(masks.not_grant_or_concessional(), F.lit(False)))
    flow_types = F.array_compact(F.array(
        F.lit("all"), F.when(F.col("__market"), "excluding_concessional")
    ))
    summed = (
        sum_by(marked, (*OUTPUT_GROUPER, "__market"))
        .withColumn("flow_type", F.explode(flow_types))
        .transform(filters.keep_countries_with_outflows, "flow_type")
        .withColumn("indicator_type", F.explode(F.array(F.col("indicator_type"), F.lit("net_flow"))))
    )
    complete = F.col("prices").isNotNull() & F.col("year").isNotNull()
    blank = {"continent": missing(), "income_level": missing()}
    income = F.col("income_level").isNotNull() & (F.col("income_level") != HIGH_INCOME)
    levels = [
        totals.itself(),
        totals.developing_level(settings.developing),
        ({"country": F.col("income_level"), **blank}, complete & income),
        ({"country": F.lit(settings.africa), **blank}, complete & (F.col("continent") == settings.africa)),
    ]
    return totals.relabel_and_sum(summed, levels, drop=["__market"])


def historical_inflows(flows: DataFrame, settings: FlowSettings, *, debt_only: bool = False,
                       version: str = "total", china_as_counterpart_type: bool = False,
                       exclude_outliers: bool = True,
                       remove_countries_wo_outflows: bool = True) -> DataFrame:
    """Inflows up to the latest year. Rows with a NULL label drop out of the country rows."""
    rows = flows.where(F.col("year") <= settings.latest_year).transform(filters.apply_version, version)
    if exclude_outliers:
        rows = filters.exclude_outlier_countries(rows, settings.outliers)
    if debt_only:
        grant_inflow = (F.col("indicator_type") == "inflow") & masks.is_any("indicator", GRANT_INDICATORS)
        rows = rows.where(~F.coalesce(grant_inflow, F.lit(False)))
    rows = _by_counterpart(rows, settings, china_as_counterpart_type, ["indicator"])
    if remove_countries_wo_outflows:
        rows = filters.keep_countries_with_outflows(rows)
    inflows = rows.where(F.col("indicator_type") == "inflow")
    result = totals.with_developing_total(inflows, settings.developing)
    result = result.dropna(subset=[c for c in result.columns if c != "value"])
    return filters.relabel_counterparts(result) if china_as_counterpart_type else result


def _by_counterpart(rows: DataFrame, settings: FlowSettings, china: bool, drop: list[str]) -> DataFrame:
    """Sum away ``drop``, and the counterpart area when China gets its own type."""
    if china:
        rows = filters.split_counterpart(rows, settings.china).drop("counterpart_area")
    return sum_by(rows, [c for c in rows.columns if c not in ("value", *drop)])


def _outflows(flows: DataFrame, settings: FlowSettings, version: str, exclude_outliers: bool,
              remove_countries_wo_outflows: bool, china: bool) -> DataFrame:
    """Outflow rows of a version. Here the version filter follows the outflow rule, so it is
    carried through the sum as a flag."""
    mask = masks.version_mask(version)
    keep = F.lit(True) if mask is None else F.coalesce(mask, F.lit(False))
    rows = flows.withColumn("__version", keep)
    if exclude_outliers:
        rows = filters.exclude_outlier_countries(rows, settings.outliers)
    rows = _by_counterpart(rows, settings, china, ["indicator"])
    if remove_countries_wo_outflows:
        rows = filters.keep_countries_with_outflows(rows)
    return rows.where("indicator_type = 'outflow' and __version").drop("__version")


def debt_service_report(flows: DataFrame, settings: FlowSettings, version: str = "total", *,
                        exclude_outliers: bool = True, remove_countries_wo_outflows: bool = True,
                        china_as_counterpart_type: bool = False) -> DataFrame:
    """Debt service as positive amounts, history and projections."""
    rows = flows.where(F.col("year") <= settings.last_service_year)
    rows = _outflows(rows, settings, version, exclude_outliers, remove_countries_wo_outflows, china_as_counterpart_type)
    paid = totals.with_developing_total(rows, settings.developing, drop=["indicator_type"])
    return paid.withColumn("value", -F.col("value"))


def projected_outflows(flows: DataFrame, settings: FlowSettings, version: str = "total", *,
                       exclude_outliers: bool = True,
                       remove_countries_wo_outflows: bool = True) -> DataFrame:
    """Outflow estimates for the years after the latest inflows."""
    rows = flows.where(F.col("year") > settings.latest_year).drop("counterpart_area", "counterpart_type")
    rows = _outflows(rows, settings, version, exclude_outliers, remove_countries_wo_outflows, False)
    return totals.with_developing_total(rows, settings.developing)


def inflows_table(flows: DataFrame, settings: FlowSettings) -> DataFrame:
    """Debt inflows by counterpart type with income-level and Africa rows (chart input)."""
    rows = historical_inflows(flows, settings, debt_only=True, china_as_counterpart_type=True)
    return _counterpart_table(rows, settings)


def debt_service_table(flows: DataFrame, settings: FlowSettings) -> DataFrame:
    rows = debt_service_report(flows, settings, china_as_counterpart_type=True)
    return _counterpart_table(rows, settings)


def _counterpart_table(rows: DataFrame, settings: FlowSettings) -> DataFrame:
    """Country rows plus income-level and Africa rows by counterpart type, in one pass."""
    complete = F.col("year").isNotNull() & F.col("counterpart_type").isNotNull()
    single = masks.differs("country", settings.developing) & masks.differs("income_level", HIGH_INCOME)
    label = {"continent": missing(), "income_level": missing(), "prices": F.lit("current")}
    if "indicator_type" in rows.columns:
        label["indicator_type"] = missing()
    levels = [
        totals.itself(),
        ({"country": F.col("income_level"), **label}, complete & single & F.col("income_level").isNotNull()),
        ({"country": F.col("continent"), **label}, complete & (F.col("continent") == settings.africa)),
    ]
    return totals.relabel_and_sum(rows, levels).withColumn("period", missing())
