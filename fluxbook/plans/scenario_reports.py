"""Scenario tables: inflows and aid carried forward, netted against outflow estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fluxbook.functions import masks
from fluxbook.functions.values import columns_except, missing, sum_by, total
from fluxbook.operators import filters, scenarios as sc, totals
from fluxbook.operators.joins import add_iso_codes, natural_left_join
from fluxbook.operators.reshape import pivot_unique
from fluxbook.operators.series import keep_latest_year
from fluxbook.plans.flows import flows_by_version
from fluxbook.settings import FlowSettings
from fluxbook.vocabulary import DAC_TOTAL, HIGH_INCOME, OUTPUT_GROUPER

PUBLISHED = (sc.SCENARIO_1, sc.SCENARIO_2, sc.SCENARIO_3)
HISTORY = sc.Scenario("ODA", extend=False)
AID_TITLES = {
    "ODA": "ODA",
    "scenario 2": "ODA (Projected Scenario 2)",
    "scenario 3": "ODA (Projected Scenario 3)",
}


def latest_inflows(flows: DataFrame, settings: FlowSettings, *, exclude_outliers: bool = True,
                   remove_countries_wo_outflows: bool = True,
                   china_as_counterpart_type: bool = False) -> DataFrame:
    """Inflow rows of the last year with inflows, and their developing-countries total."""
    inflows = flows_by_version(
        flows, settings, exclude_outliers=exclude_outliers,
        remove_countries_wo_outflows=remove_countries_wo_outflows,
        china_as_counterpart_type=china_as_counterpart_type,
    ).where(F.col("indicator_type") == "inflow")
    return totals.with_developing_total(keep_latest_year(inflows), settings.developing)


def inflow_scenarios(latest: DataFrame, isos: DataFrame, factors: DataFrame, settings: FlowSettings,
                     scenarios: Sequence[sc.Scenario] = PUBLISHED,
                     version: str = "concessional_finance") -> DataFrame:
    """Scenario inflows by country. ``latest`` holds rows of one year only, so that year is
    every row's start."""
    projected = latest.transform(add_iso_codes, isos, "counterpart_area").transform(
        sc.project_scenarios, factors, scenarios, version, settings.target_year,
        settings.usa_iso, F.col("year"),
    )
    return sum_by(projected, (*OUTPUT_GROUPER, "scenario"))


def net_flow_scenarios(inflows: DataFrame, outflows: DataFrame, settings: FlowSettings) -> DataFrame:
    """Scenario inflows against outflow estimates, with income-level and Africa rows."""
    ahead = (
        inflows.where(masks.differs("year", settings.latest_year))
        .drop("indicator_type").withColumnRenamed("value", "inflows")
    )
    paid = outflows.drop("indicator_type").withColumnRenamed("value", "outflows")
    both = natural_left_join(ahead, paid)
    complete = F.col("year").isNotNull() & F.col("scenario").isNotNull()
    income = F.col("income_level").isNotNull() & masks.differs("income_level", HIGH_INCOME)
    label = {"continent": missing(), "income_level": missing(), "prices": F.lit("current")}
    levels = [
        totals.itself(),
        ({"country": F.col("income_level"), **label}, complete & income & masks.differs("country", settings.developing)),
        ({"country": F.col("continent"), **label}, complete & (F.col("continent") == settings.africa)),
    ]
    measures = ("inflows", "outflows")
    rows = totals.relabel(both, levels)
    # A country without an estimate keeps its NULL; in a group total it counts as 0.
    sums = [F.when(F.col("__level") == 0, F.sum(m)).otherwise(total(m)).alias(m) for m in measures]
    return (
        rows.groupBy(*columns_except(rows, *measures)).agg(*sums).drop("__level")
        .withColumn("net_flows", F.col("inflows") + F.col("outflows"))
    )


def aid_scenario(aid: DataFrame, isos: DataFrame, factors: DataFrame, settings: FlowSettings,
                 scenario: sc.Scenario) -> DataFrame:
    """One scenario of total aid by donor, with the donor total."""
    return _projected_aid(aid, isos, factors, settings, [scenario]).drop("scenario")


def _projected_aid(aid: DataFrame, isos: DataFrame, factors: DataFrame, settings: FlowSettings,
                   scenarios: Sequence[sc.Scenario]) -> DataFrame:
    coded = aid.transform(add_iso_codes, isos, "donor_code", "donor_code")
    projected = sc.project_scenarios(
        coded, factors, scenarios, None, settings.target_year, settings.usa_iso
    )
    donor_total = {c: F.lit(x) for c, x in DAC_TOTAL.items() if c in projected.columns}
    labelled = [c for c in projected.columns if c != "value" and c not in donor_total]
    complete = ~F.exists(F.array(*[F.col(c).isNull() for c in labelled]), lambda x: x)
    return totals.relabel_and_sum(projected, [totals.itself(), (donor_total, complete)])


def donor_order() -> list[Column]:
    """The donor total first."""
    total_first = F.when(F.col("donor_name") == DAC_TOTAL["donor_name"], 0).otherwise(1)
    return [total_first, F.col("donor_name").asc_nulls_last(), F.col("year").asc_nulls_last()]


def aid_scenarios(aid: DataFrame, isos: DataFrame, factors: DataFrame, settings: FlowSettings,
                  scenarios: Sequence[sc.Scenario] = PUBLISHED[1:]) -> DataFrame:
    """History and two scenarios side by side, donor total first. One pass, no outer joins."""
    rows = _projected_aid(aid, isos, factors, settings, [HISTORY, *scenarios])
    titled = rows.withColumn("scenario", masks.recode("scenario", AID_TITLES))
    wide = pivot_unique(
        titled, ["year", "donor_name", "currency", "prices"], "scenario", list(AID_TITLES.values())
    )
    first_projected = settings.latest_year + 1
    blanked = filters.null_before(wide, first_projected, *list(AID_TITLES.values())[1:])
    return blanked.orderBy(*donor_order())
