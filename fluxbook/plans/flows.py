"""From landed sources to the flow table: grants, debt inflows, debt service, all flows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from fluxbook import vocabulary as v
from fluxbook.operators import filters, totals
from fluxbook.operators.concessional import debt_by_direction
from fluxbook.operators.filters import Members
from fluxbook.operators.joins import add_donor_and_recipient_names, add_income_level, spread_join
from fluxbook.operators.landing import AID, flows_of_landed, land_together
from fluxbook.operators.names import NameBook, clean_creditors, clean_debtors
from fluxbook.operators.series import deflate, to_constant_prices
from fluxbook.settings import FlowSettings
from fluxbook.sources.scans import scan_aid, scan_debt, to_units


@dataclass(frozen=True)
class FlowSources:
    """Landed tables and code groups. ``debtor_names`` and ``creditor_names`` are optional
    one-column lists of the names in use; they save a scan for the distinct names. ``landed`` is
    debt and aid in one table, where they come so; else the two are laid together."""

    debt: DataFrame
    aid: DataFrame
    debtors: NameBook
    creditors: NameBook
    income_levels: DataFrame
    donor_names: DataFrame
    recipient_names: DataFrame
    official_donors: Members
    bilateral_donors: Members
    developing_recipients: Members
    deflators: DataFrame | None = None
    debtor_names: DataFrame | None = None
    creditor_names: DataFrame | None = None
    grants_indicator: str | None = None
    landed: DataFrame | None = None


def clean_grants(aid: DataFrame, src: FlowSources) -> DataFrame:
    """Official grants to developing countries, by recipient and donor, in units.

    The code filters run before the name joins, so that dropped rows are never joined.
    """
    rows = (
        aid.transform(filters.keep_official_donors, src.official_donors)
        .transform(filters.keep_recipient_group, src.developing_recipients)
        .transform(filters.assign_grants_indicator, src.bilateral_donors)
        .transform(filters.add_counterpart_type)
        .transform(add_donor_and_recipient_names, src.donor_names, src.recipient_names)
        .transform(clean_debtors, "recipient", src.debtors, src.recipient_names.select("recipient_name"))
        .transform(clean_creditors, "donor", src.creditors, src.donor_names.select("donor_name"))
    )
    return (
        rows.select(*v.GRANT_COLUMNS)
        .withColumnsRenamed({"donor": "counterpart_area", "recipient": "country"})
        .transform(filters.drop_counterpart_totals)
        .transform(to_units)
        .transform(add_income_level, src.income_levels)
    )


def grants_inflows(src: FlowSources, settings: FlowSettings, constant: bool = False) -> DataFrame:
    """Grants are published in both price bases, so the basis is a scan filter."""
    aid = scan_aid(
        src.aid, settings.first_year, settings.last_year,
        prices="constant" if constant else "current", indicator=src.grants_indicator,
    )
    return clean_grants(aid, src)


def clean_debt(debt: DataFrame, src: FlowSources) -> DataFrame:
    """Canonical names, integer year, income level and counterpart type; no empty values."""
    return (
        debt.withColumn("counterpart_area", F.btrim("counterpart_area", F.lit(" \t\r\n")))
        .transform(filters.drop_empty_values)
        .transform(clean_debtors, "country", src.debtors, src.debtor_names)
        .transform(clean_creditors, "counterpart_area", src.creditors, src.creditor_names)
        .withColumn("year", F.year("year"))
        .transform(add_income_level, src.income_levels)
        .transform(filters.add_counterpart_type)
    )


def _codes(book: dict) -> list[str]:
    split = [c for pairs in book["split"].values() for pair in pairs for c in pair]
    return split + [c for plain in book["plain"].values() for c in plain]


def debt_flows(src: FlowSources, settings: FlowSettings, constant: bool = False,
               directions: tuple[str, ...] = ("inflow", "outflow")) -> DataFrame:
    """Disbursements and debt service, as positive amounts, from one scan of the debt table.

    Disbursements end with the analysis years; debt service includes the years the source
    projects.
    """
    projected = settings.last_year + settings.service_projection_years
    books = {
        "inflow": (v.DISBURSEMENT_CODES, settings.last_year),
        "outflow": (v.DEBT_SERVICE_CODES, projected),
    }
    books = {d: books[d] for d in directions}
    last = max(year for _, year in books.values())
    rows = scan_debt(src.debt, [c for b, _ in books.values() for c in _codes(b)], settings.first_year, last)
    for book, year in books.values():
        if year < last:
            rows = rows.where(~F.col("indicator").isin(*_codes(book)) | (F.year("year") <= year))
    rows = debt_by_direction(rows, {d: book for d, (book, _) in books.items()}).transform(clean_debt, src)
    if not constant:
        return rows.withColumn("prices", F.lit("current"))
    if src.deflators is None:
        raise ValueError("Constant prices need a deflator table.")
    return to_constant_prices(rows, src.deflators)


def debt_inflows(src: FlowSources, settings: FlowSettings, constant: bool = False) -> DataFrame:
    """Disbursements by indicator."""
    return debt_flows(src, settings, constant, ("inflow",)).drop("indicator_type")


def debt_service(src: FlowSources, settings: FlowSettings, constant: bool = False) -> DataFrame:
    """Principal and interest by indicator, including the years the source projects."""
    return debt_flows(src, settings, constant, ("outflow",))


DIRECTIONS = ("inflow", "outflow")


def _donors(src: FlowSources) -> DataFrame:
    """Code, name and kind of every official donor; who is not listed gives no grants."""
    spark, kind = src.donor_names.sparkSession, src.donor_names.schema["donor_code"].dataType
    official = src.official_donors
    codes = official.toDF("donor_code") if isinstance(official, DataFrame) else spark.createDataFrame([(c,) for c in official], "donor_code long")
    others = spark.createDataFrame([(c,) for c in v.OTHER_OFFICIAL_DONORS], "donor_code long")
    codes = codes.select(F.col("donor_code").cast(kind)).unionByName(others.select(F.col("donor_code").cast(kind))).distinct()
    return (
        codes.join(src.donor_names, "donor_code", "left").transform(filters.assign_grants_indicator, src.bilateral_donors)
        .select("donor_code", F.col("donor_name").alias("donor"), F.col("indicator").alias("grants"))
    )


def _recipients(src: FlowSources) -> DataFrame:
    kind = src.recipient_names.schema["recipient_code"].dataType
    group, spark = src.developing_recipients, src.recipient_names.sparkSession
    codes = group.toDF("recipient_code") if isinstance(group, DataFrame) else spark.createDataFrame([(c,) for c in group], "recipient_code long")
    named = codes.select(F.col("recipient_code").cast(kind)).distinct().join(src.recipient_names, "recipient_code", "left")
    return named.select("recipient_code", F.col("recipient_name").alias("recipient"), F.lit(True).alias("developing"))


def flow_rows(src: FlowSources, settings: FlowSettings, constant: bool = False, directions: tuple[str, ...] = DIRECTIONS) -> DataFrame:
    """Grants and debt flows as positive amounts, with canonical names and labels, in one pass.

    Both sources are summed together by their own keys before any name is looked up; from there
    on the rows are bounded by the dimensions. Grants come in the wanted prices, debt is deflated.
    """
    if constant and src.deflators is None:
        raise ValueError("Constant prices need a deflator table.")
    landed = land_together(src.debt, src.aid) if src.landed is None else src.landed
    books = {
        "inflow": (v.DISBURSEMENT_CODES, settings.last_year),
        "outflow": (v.DEBT_SERVICE_CODES, settings.last_year + settings.service_projection_years),
    }
    rows = flows_of_landed(
        landed, {d: books[d] for d in directions}, settings.first_year, settings.last_year if "inflow" in directions else None,
        "constant" if constant else "current", src.grants_indicator,
    )
    aid = F.col("source") == AID
    named = (
        spread_join(spread_join(rows, _donors(src), ["donor_code"]), _recipients(src), ["recipient_code"])
        .where(~aid | (F.col("grants").isNotNull() & F.col("developing")))
        .withColumns({
            "indicator": F.when(aid, F.col("grants")).otherwise(F.col("indicator")),
            "country": F.when(aid, F.col("recipient")).otherwise(F.col("country")),
            "counterpart_area": F.when(aid, F.col("donor")).otherwise(F.btrim("counterpart_area", F.lit(" \t\r\n"))),
        })
        .drop("grants", "developing", "recipient", "donor", "recipient_code", "donor_code")
    )
    both = lambda names, listed: None if listed is None else names.toDF("name").unionByName(listed.toDF("name"))
    clean = (
        named.transform(clean_debtors, "country", src.debtors, both(src.recipient_names.select("recipient_name"), src.debtor_names))
        .transform(clean_creditors, "counterpart_area", src.creditors, both(src.donor_names.select("donor_name"), src.creditor_names))
        .where(~aid | filters.is_no_total("counterpart_area"))
        .transform(filters.add_counterpart_type)
        .transform(add_income_level, src.income_levels)
    )
    if not constant:
        return clean.drop("source")
    real = deflate(clean.withColumn("__aid", F.when(aid, F.col("value"))), src.deflators)
    value = F.when(aid, F.col("__aid").cast(real.schema["value"].dataType)).otherwise(F.col("value"))
    return real.withColumns({"value": value, "prices": F.lit("constant")}).drop("source", "__aid")


def total_inflows(src: FlowSources, settings: FlowSettings, constant: bool = False) -> DataFrame:
    """Grants and disbursements; the rows of one key of a source are summed."""
    return flow_rows(src, settings, constant, ("inflow",))


def all_flows(src: FlowSources, settings: FlowSettings, constant: bool = False) -> DataFrame:
    """The flow table: inflows positive, outflows negative, no zero rows."""
    flows = flow_rows(src, settings, constant).transform(totals.prep_flows, settings.world)
    signed = F.when(F.col("indicator_type") == "outflow", -F.col("value")).otherwise(F.col("value"))
    return (
        flows.withColumn("value", signed)
        .drop("iso_code", "counterpart_iso_code")
        .where(F.col("value") != 0)
    )


def flows_by_version(flows: DataFrame, settings: FlowSettings, *, as_net_flows: bool = False,
                     version: str = "total", exclude_outliers: bool = True,
                     remove_countries_wo_outflows: bool = True,
                     china_as_counterpart_type: bool = False,
                     exclude_outflow_estimates: bool = True) -> DataFrame:
    """Flow table of one version after the exclusions.

    The version filter comes before the outflow rule: a country whose outflows are all
    concessional is not part of the version without concessional finance.
    """
    if exclude_outflow_estimates:
        flows = flows.where(F.col("year") <= settings.latest_year)
    flows = filters.apply_version(flows, version)
    flows = exclusions(
        flows, settings, exclude_outliers, remove_countries_wo_outflows, china_as_counterpart_type
    )
    return totals.net_flows(flows) if as_net_flows else flows


def exclusions(flows: DataFrame, settings: FlowSettings, exclude_outliers: bool,
               remove_countries_wo_outflows: bool, china_as_counterpart_type: bool) -> DataFrame:
    if exclude_outliers:
        flows = filters.exclude_outlier_countries(flows, settings.outliers)
    if remove_countries_wo_outflows:
        flows = filters.keep_countries_with_outflows(flows)
    if china_as_counterpart_type:
        flows = filters.split_counterpart(flows, settings.china).transform(totals.drop_counterpart_area)
    return flows
