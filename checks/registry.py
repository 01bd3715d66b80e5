"""Every operator and report as a query over the trade tables, with its SQL counterpart.

Money is summed as exact decimals and turned into doubles in the last step, so that results
do not depend on the order of the sums. Derived doubles are rounded where the two engines
may multiply in a different order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from checks.relations import (
    BASE_YEAR, GROUPS, PATTERNS, PERIODS, PROJECTION_SHIFT, TRADE, Trade, trade,
)
from checks.sqltext import cents, dbl, half_even, query
from fluxbook.functions import masks
from fluxbook.operators import concessional, filters, joins, names, periods, reshape, scenarios as sc, series, totals
from fluxbook.plans import charts, flows as fl, reports, scenario_reports as sr
from fluxbook.sources import scans, schemas, sinks
from fluxbook.vocabulary import DISBURSEMENT_CODES, OUTPUT_GROUPER

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FLOW = "year, country, continent, income_level, counterpart_area, counterpart_type, indicator, indicator_type, prices"
GROUPER = ", ".join(OUTPUT_GROUPER)
RAMP = sc.Ramp(0.1, 2002, 2004)
SCENARIO_3 = sc.Scenario("scenario 3", donors=True, usa=80, rest=10, ramp=RAMP)
SCENARIOS = (sc.SCENARIO_1, sc.SCENARIO_2, SCENARIO_3)
HISTORY_TYPES = ("Bilateral (excl. China)", "China", "Multilateral", "Private (excl. China)")
SERVICE_TYPES = ("Bilateral", "China", "Multilateral", "Private")
UNIT = 1e6


def finish(df: DataFrame) -> DataFrame:
    """Decimals to doubles, as the last step."""
    money = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({c: F.col(f"`{c}`").cast("decimal(38,4)").cast("double") for c in money})


def to_cents(df: DataFrame, *columns: str) -> DataFrame:
    """Scaled amounts rounded to two digits."""
    return df.withColumns({c: F.round(F.col(f"`{c}`"), 2) for c in columns or ("value",)})


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def register(key: str, build: Callable[[Trade], DataFrame], sql: str | None, **instead: str) -> None:
    QUERIES[key] = lambda spark, folder: finish(build(trade(spark, folder)))
    if sql is not None:
        ORACLES[key] = query(sql, **instead)


def ranked(sql: str, order: str) -> str:
    """Rows of a query with their place in an order."""
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM ({sql})"


# --- scans, sources and sinks ------------------------------------------------------------

SCAN_CODES = ("DT.DIS.BLAT.CD", "DT.DIS.PBND.CD", "DT.AMT.MLAT.CD")


def _year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("year"))


register(
    "scan_debt",
    lambda t: _year(scans.scan_debt(t.debt_raw, SCAN_CODES, 1996, 1999)),
    f"""SELECT indicator, year, country, counterpart_area, {dbl('value')} AS value FROM debt_raw
    WHERE indicator IN {SCAN_CODES} AND year BETWEEN 1996 AND 1999""",
)
register(
    "scan_aid",
    lambda t: scans.scan_aid(
        t.aid_raw, 1996, 1999, prices="constant", indicator="recipient_grants_flow",
        donors=(1, 2, 3, 12), donor_names=t.donor_names, recipient_names=t.recipient_names,
    ).transform(scans.to_units),
    f"""SELECT a.year, a.donor_code, a.recipient_code, a.prices, 'recipient_grants_flow' AS indicator,
        {dbl('a.units')} AS value, d.n_name AS donor,
        r.n_name || CASE WHEN r.n_nationkey >= 23 THEN ', Total' ELSE '' END AS recipient
    FROM aid_raw a JOIN nation d ON a.donor_code = d.n_nationkey JOIN nation r ON a.recipient_code = r.n_nationkey
    WHERE a.donor_code IN (1, 2, 3, 12) AND a.year BETWEEN 1996 AND 1999 AND a.prices = 'constant'""",
)
register(
    "scan_macro",
    lambda t: scans.scan_macro(t.macro, "NGDPD", 1996),
    "SELECT iso_code, year, value FROM macro WHERE indicator = 'NGDPD' AND iso_code IS NOT NULL AND year >= 1996",
)
register(
    "dim_names",
    lambda t: totals.union_by_name(
        *[
            scans.dim_names(t.code_list, side, 1996, 2000).select(
                F.lit(side).alias("side"), F.col(f"{side}_code").alias("code"), F.col(f"{side}_name").alias("name")
            ) for side in ("donor", "recipient")
        ]
    ),
    """SELECT DISTINCT 'donor' AS side, creditor AS code,
        n_name || CASE WHEN n_nationkey >= 23 THEN ', Total' ELSE '' END AS name
    FROM facts JOIN nation ON creditor = n_nationkey WHERE status = 'O' AND year BETWEEN 1996 AND 2000
    UNION ALL SELECT DISTINCT 'recipient', debtor, n_name || CASE WHEN n_nationkey >= 23 THEN ', Total' ELSE '' END
    FROM facts JOIN nation ON debtor = n_nationkey WHERE status = 'O' AND year BETWEEN 1996 AND 2000""",
)
register(
    "scan_gni",
    lambda t: joins.add_gni_per_capita(t.gni, t.gni_pc).transform(rounded, 6, "gni_pc"),
    "SELECT year, entity_code, gni, CASE WHEN entity_code IS NOT NULL THEN round(gni_pc, 6) END AS gni_pc FROM balances",
)
register(
    "read_projections",
    lambda t: t.projections,
    "SELECT * FROM projections",
)
register(
    "clean_columns",
    lambda t: t.projections_raw.transform(sc.clean_columns),
    """SELECT n.year + 4 AS year, CASE WHEN t.k < 10 THEN t.country END AS donor, n.ngdp * 3 AS gni, n.ngdp AS oda_realistic,
        n.finished AS oda_downside, n.ngdp_r AS health_bilateral_realistic,
        n.ngdp_r * 2 AS wb_multilateral_upside, n.ngdp_r * 4 AS agriculture_bilateral_upside
    FROM nation_years n JOIN nat t ON n.k = t.k""",
)
register(
    "select_family",
    lambda t: t.projections.transform(sc.select_family, "oda"),
    "SELECT year, donor, oda_downside AS downside, oda_realistic AS realistic FROM projections",
)


def _csv_roundtrip(t: Trade) -> DataFrame:
    path = sinks.shared_folder(t.spark, "net_flows_csv")
    rows = finish(reports.net_flows_report(t.flows, TRADE)).select(*schemas.NET_FLOWS.names)
    sinks.write_csv(rows, path)
    return scans.read_csv(t.spark, path, schemas.NET_FLOWS)


def _parquet_roundtrip(t: Trade) -> DataFrame:
    path = sinks.shared_folder(t.spark, "debt_inflows_parquet")
    sinks.write_parquet(finish(t.flow_table), path)
    return scans.read_table(t.spark, path, schemas.FLOWS).where("year >= 1998")


def _landed_debt(t: Trade) -> DataFrame:
    path = sinks.shared_folder(t.spark, "debt_landed")
    sinks.land_debt(t.debt_raw, path)
    return _year(scans.scan_debt(scans.read_table(t.spark, path), SCAN_CODES, 1996, 1999))


register("csv_roundtrip", _csv_roundtrip, f"SELECT {GROUPER}, flow_type, {dbl('value')} AS value FROM report")
register("parquet_roundtrip", _parquet_roundtrip, f"SELECT {FLOW}, {dbl('value')} AS value FROM flows WHERE year >= 1998")
register("scan_landed_debt", _landed_debt, f"""
    SELECT indicator, year, country, counterpart_area, {dbl('value')} AS value FROM debt_raw
    WHERE indicator IN {SCAN_CODES} AND year BETWEEN 1996 AND 1999""")

# --- projections, filters, relabels ------------------------------------------------------

register(
    "assign_indicator",
    lambda t: _year(t.debt_raw.where("indicator = 'DT.DIS.PBND.CD'").transform(filters.assign_indicator, "bonds")),
    f"""SELECT year, country, counterpart_area, {dbl('value')} AS value, 'bonds' AS indicator
    FROM debt_raw WHERE indicator = 'DT.DIS.PBND.CD'""",
)


def _aid(t: Trade) -> DataFrame:
    return t.aid_raw.where("prices = 'current'").select(
        "year", "donor_code", "recipient_code", (F.col("value") * 1_000_000).alias("value")
    )


AID = f"SELECT year, donor_code, recipient_code, {dbl('units')} AS value FROM aid_raw WHERE prices = 'current'"
register(
    "official_donors",
    lambda t: _aid(t).transform(filters.keep_official_donors, t.group("n_nationkey < 20")),
    f"{AID} AND donor_code < 20",
)
register(
    "official_donors_listed",
    lambda t: _aid(t).withColumn("donor_code", F.when(F.col("donor_code") == 22, 1055).otherwise(F.col("donor_code")))
    .transform(filters.keep_official_donors, t.group("n_nationkey < 20")),
    f"""SELECT year, CASE donor_code WHEN 22 THEN 1055 ELSE donor_code END AS donor_code, recipient_code, {dbl('units')} AS value
    FROM aid_raw WHERE prices = 'current' AND (donor_code < 20 OR donor_code = 22)""",
)
register(
    "scan_aid_totals",
    lambda t: scans.scan_aid_totals(
        t.aid_total.withColumn("donor_code", F.when(F.col("donor_code") == 5, 83).otherwise(F.col("donor_code"))), range(5), 1996, 1999,
    ),
    f"""SELECT f.year, CASE n.k WHEN 5 THEN 83 ELSE n.k END AS donor_code, n.country AS donor_name, 'USD' AS currency,
        'current' AS prices, 'total_oda' AS indicator, {dbl('sum(f.principal)')} AS value
    FROM facts f JOIN nat n ON n.k = f.creditor WHERE f.status = 'O' AND f.line IN (1, 2) AND n.k <= 5
        AND f.year BETWEEN 1996 AND 1999 GROUP BY f.year, n.k, n.country""",
)
register(
    "recipient_group",
    lambda t: _aid(t).transform(filters.keep_recipient_group, t.group("n_nationkey <> 24")),
    f"{AID} AND recipient_code <> 24",
)
register(
    "grants_indicator",
    lambda t: _aid(t).transform(filters.assign_grants_indicator, t.group("n_nationkey % 2 = 0")),
    f"""SELECT year, donor_code, recipient_code, {dbl('units')} AS value, CASE donor_code % 2
        WHEN 0 THEN 'grants_bilateral' ELSE 'grants_multilateral' END AS indicator
    FROM aid_raw WHERE prices = 'current'""",
)
register(
    "add_names",
    lambda t: _aid(t).transform(joins.add_donor_and_recipient_names, t.donor_names, t.recipient_names),
    f"""SELECT year, donor_code, recipient_code, {dbl('units')} AS value,
        d.n_name || CASE WHEN d.n_nationkey >= 23 THEN ', Total' ELSE '' END AS donor,
        r.n_name || CASE WHEN r.n_nationkey >= 23 THEN ', Total' ELSE '' END AS recipient
    FROM aid_raw JOIN nation d ON donor_code = d.n_nationkey JOIN nation r ON recipient_code = r.n_nationkey
    WHERE prices = 'current'""",
)


def _totals_named(t: Trade, column: str) -> DataFrame:
    marked = F.when(F.col(column).isin("NATION_23", "NATION_24"), F.concat(column, F.lit(", Total")))
    return t.flow_table.withColumn(column, marked.otherwise(F.col(column)))


register(
    "drop_cp_totals",
    lambda t: _totals_named(t, "counterpart_area").transform(filters.drop_counterpart_totals),
    f"SELECT {FLOW}, {dbl('value')} AS value FROM flows WHERE counterpart_area NOT IN ('NATION_23', 'NATION_24')",
)
register(
    "drop_rec_totals",
    lambda t: _totals_named(t, "country").transform(filters.drop_recipient_totals),
    f"SELECT {FLOW}, {dbl('value')} AS value FROM flows WHERE country NOT IN ('NATION_23', 'NATION_24')",
)
register(
    "exclude_outliers",
    lambda t: filters.exclude_outlier_countries(t.flow_table, TRADE.outliers),
    f"SELECT {FLOW}, {dbl('value')} AS value FROM flows WHERE country NOT IN ('NATION_3', 'NATION_7', 'NATION_9')",
)
register(
    "counterpart_type",
    lambda t: t.flow_table.drop("counterpart_type").transform(filters.add_counterpart_type),
    f"SELECT {FLOW}, {dbl('value')} AS value FROM flows",
)
register(
    "split_counterpart",
    lambda t: filters.split_counterpart(t.flow_table, TRADE.china),
    f"""SELECT * REPLACE (CASE WHEN counterpart_area = 'NATION_8' THEN 'China' ELSE counterpart_type END
        AS counterpart_type, {dbl('value')} AS value) FROM flows""",
)
MASKED = "year, country, counterpart_area, indicator, indicator_type"
register(
    "mask_grants",
    lambda t: t.flow_table.select(*MASKED.split(", "), masks.not_grant().alias("keep")),
    f"SELECT {MASKED}, indicator NOT LIKE 'grants%' AS keep FROM flows",
)
register(
    "mask_concessional",
    lambda t: t.flow_table.select(*MASKED.split(", "), masks.not_grant_or_concessional().alias("keep")),
    f"""SELECT {MASKED}, indicator NOT LIKE 'grants%' AND indicator NOT IN
        ('bilateral_concessional', 'multilateral_concessional') AS keep FROM flows""",
)
register(
    "excl_grants",
    lambda t: t.flow_table.transform(filters.exclude_grants),
    f"SELECT {FLOW}, {dbl('value')} AS value FROM flows WHERE indicator NOT LIKE 'grants%'",
)
register(
    "excl_concessional",
    lambda t: t.flow_table.transform(filters.exclude_grants_and_concessional),
    f"SELECT {FLOW}, {dbl('value')} AS value FROM market",
)
register(
    "semi_outflows",
    lambda t: t.flow_table.transform(filters.keep_countries_with_outflows),
    f"""SELECT {FLOW}, {dbl('value')} AS value FROM flows WHERE (year, country) IN
        (SELECT (year, country) FROM flows WHERE indicator_type = 'outflow')""",
)
register(
    "semi_outflows_facts",
    lambda t: t.flow_rows.transform(filters.semi_join_outflows, t.table("nation", "n_name"), 10).select(
        "year", "country", "counterpart_area", "indicator", "indicator_type", "value"
    ),
    f"""SELECT year, country, counterpart_area, indicator, indicator_type, {dbl('value')} AS value FROM flow_rows
    WHERE (year, country) IN (SELECT (year, country) FROM flow_rows WHERE indicator_type = 'outflow')""",
)

# --- joins -------------------------------------------------------------------------------

register(
    "concessional_split",
    lambda t: _year(concessional.concessional_split(t.debt_raw, "DT.DIS.BLAT.CD", "DT.DIS.BLTC.CD", "bilateral")),
    f"""SELECT t.year, t.country, t.counterpart_area, 'bilateral' || k.kind AS indicator,
        {dbl("CASE k.kind WHEN '_concessional' THEN c.value ELSE coalesce(t.value, 0) - coalesce(c.value, 0) END")} AS value
    FROM debt_raw t CROSS JOIN (VALUES ('_concessional'), ('_non_concessional')) k(kind)
    LEFT JOIN debt_raw c ON c.indicator = 'DT.DIS.BLTC.CD' AND c.year = t.year AND c.country = t.country
        AND c.counterpart_area = t.counterpart_area WHERE t.indicator = 'DT.DIS.BLAT.CD'""",
)


def _debt_with_nan(t: Trade) -> DataFrame:
    year, code = F.year("year") % 3, F.col("indicator")
    missing = ((year == 0) & (code == "DT.DIS.BLAT.CD")) | ((year == 1) & (code == "DT.DIS.BLTC.CD"))
    return t.debt_raw.withColumn("value", F.when(missing, float("nan")).otherwise(F.col("value").cast("double")))


register(
    "concessional_split_nan",
    lambda t: _year(concessional.concessional_split(_debt_with_nan(t), "DT.DIS.BLAT.CD", "DT.DIS.BLTC.CD", "bilateral"))
    .transform(rounded, 4, "value"),
    """SELECT t.year, t.country, t.counterpart_area, 'bilateral' || k.kind AS indicator,
        round(CASE k.kind WHEN '_concessional' THEN c.known ELSE coalesce(t.known, 0) - coalesce(c.known, 0) END, 4) AS value
    FROM (SELECT *, CASE WHEN year % 3 <> 0 THEN CAST(value AS DOUBLE) END AS known FROM debt_raw) t
    CROSS JOIN (VALUES ('_concessional'), ('_non_concessional')) k(kind)
    LEFT JOIN (SELECT *, CASE WHEN year % 3 <> 1 THEN CAST(value AS DOUBLE) END AS known FROM debt_raw) c
        ON c.indicator = 'DT.DIS.BLTC.CD' AND c.year = t.year AND c.country = t.country
        AND c.counterpart_area = t.counterpart_area WHERE t.indicator = 'DT.DIS.BLAT.CD'""",
)


def _trimmed_debt(t: Trade) -> DataFrame:
    return _year(t.debt_raw).withColumn("counterpart_area", F.trim("counterpart_area"))


register(
    "clean_debtors",
    lambda t: names.clean_debtors(_trimmed_debt(t), "country", t.book, t.table("nation", "n_name")),
    f"""SELECT d.iso_code, coalesce(d.name, r.country) AS country, coalesce(d.continent, r.country) AS continent,
        r.indicator, r.year, trim(r.counterpart_area) AS counterpart_area, {dbl('r.value')} AS value
    FROM debt_raw r LEFT JOIN names d ON r.country = d.raw_name""",
)


def _many_patterns(t: Trade) -> names.NameBook:
    """The patterns as a table behind 300 others that fit no name, or only as a later choice."""
    others = [names.NamePattern(f"(?i)^(no )?nation_{k}[0-9]*$", f"ISO_O{k}", f"Other {k}", None) for k in range(100, 390)]
    late = [names.NamePattern("(?i)n.tion", "ISO_L", "Late", "Late"), names.NamePattern("(?i)[a-z]+_1?5$", "ISO_M", "Later", "Later")]
    rows = [(n, p.pattern, p.iso_code, p.name, p.continent) for n, p in enumerate([*others, *PATTERNS, *late])]
    return names.NameBook(t.book.aliases, t.spark.createDataFrame(rows[::-1], "rank long, pattern string, iso_code string, name string, continent string"))


register(
    "clean_debtors_pattern_table",
    lambda t: names.clean_debtors(_trimmed_debt(t), "country", _many_patterns(t), t.table("nation", "n_name")),
    f"""SELECT d.indicator, d.year, trim(d.counterpart_area) AS counterpart_area, coalesce(n.iso_code, 'ISO_L') AS iso_code,
        coalesce(n.name, 'Late') AS country, coalesce(n.continent, CASE WHEN n.name IS NULL THEN 'Late' ELSE d.country END) AS continent, {dbl('d.value')} AS value
    FROM debt_raw d JOIN names n ON d.country = n.raw_name""",
)
register(
    "clean_creditors",
    lambda t: names.clean_creditors(
        _trimmed_debt(t), "counterpart_area", t.book, t.table("nation", "n_name")
    ),
    f"""SELECT r.indicator, r.year, r.country, coalesce(c.name, trim(r.counterpart_area)) AS counterpart_area,
        coalesce(c.iso_code, trim(r.counterpart_area)) AS counterpart_iso_code, {dbl('r.value')} AS value
    FROM debt_raw r LEFT JOIN names c ON trim(r.counterpart_area) = c.raw_name""",
)


def _spelt(column: str, spellings: tuple[str, ...]) -> Column:
    """Published spellings in place of the nations' names, by turns."""
    turn = F.regexp_extract(column, "[0-9]+", 0).cast("int") % (len(spellings) + 1)
    return F.coalesce(*[F.when(turn == i, name) for i, name in enumerate(spellings)], F.col(column))


register(
    "fixed_creditors",
    lambda t: names.clean_creditors(
        _trimmed_debt(t).withColumn("counterpart_area", _spelt("counterpart_area", (
            "World Bank-IDA", "Green Climate Fund [GCF]", "Korea, D.P.R. of", "GermanDem.Rep."))),
        "counterpart_area", names.NameBook(names.creditor_aliases(t.spark)),
    ),
    f"""SELECT indicator, year, country, {dbl('value')} AS value, CASE turn WHEN 0 THEN 'WB International Development Association'
            WHEN 1 THEN 'Green Climate Fund' WHEN 2 THEN 'North Korea' WHEN 3 THEN 'Germany' ELSE area END AS counterpart_area,
        CASE turn WHEN 0 THEN 'WB International Development Association' WHEN 1 THEN 'Green Climate Fund' WHEN 2 THEN 'PRK'
            WHEN 3 THEN 'GermanDem.Rep.' ELSE area END AS counterpart_iso_code
    FROM (SELECT *, trim(counterpart_area) AS area, CAST(regexp_extract(counterpart_area, '[0-9]+') AS INTEGER) % 5 AS turn FROM debt_raw)""",
)
register(
    "fixed_debtors",
    lambda t: names.clean_debtors(
        _trimmed_debt(t).withColumn("country", _spelt("country", ("Macau (China)",))), "country", names.NameBook(names.debtor_aliases(t.spark)),
    ),
    f"""SELECT CASE turn WHEN 0 THEN 'MAC' END AS iso_code, CASE turn WHEN 0 THEN 'Macau' ELSE country END AS country,
        CASE turn WHEN 0 THEN 'Asia' ELSE country END AS continent, indicator, year, trim(counterpart_area) AS counterpart_area, {dbl('value')} AS value
    FROM (SELECT *, CAST(regexp_extract(country, '[0-9]+') AS INTEGER) % 2 AS turn FROM debt_raw)""",
)
register(
    "add_iso",
    lambda t: joins.add_iso_codes(t.flow_table, t.isos, "counterpart_area"),
    f"SELECT f.* REPLACE ({dbl('f.value')} AS value), i.iso_code FROM flows f LEFT JOIN isos i ON f.counterpart_area = i.name",
)


def _debtor_sums(t: Trade) -> DataFrame:
    rows = joins.add_iso_codes(t.flows, t.isos, "country")
    return rows.groupBy("year", "iso_code", "indicator_type").agg(totals.total("value").alias("value"))


register(
    "add_income",
    lambda t: joins.add_income_level(
        t.cube.groupBy("year", F.concat(F.lit("ISO_"), "debtor").alias("iso_code")).agg(F.sum("gross").alias("value")),
        t.income_levels,
    ),
    f"""SELECT f.year, 'ISO_' || f.debtor AS iso_code, i.income_level, {dbl('sum(f.gross)')} AS value
    FROM facts f LEFT JOIN income i ON 'ISO_' || f.debtor = i.iso_code GROUP BY ALL""",
)


def _debtor_entities(t: Trade) -> DataFrame:
    return _debtor_sums(t).withColumnRenamed("iso_code", "entity_code")


register(
    "add_gni",
    lambda t: _debtor_entities(t).transform(joins.add_gni, t.gni).transform(joins.add_gni_per_capita, t.gni_pc)
    .transform(rounded, 6, "gni_pc"),
    f"""SELECT s.year, s.entity_code, s.indicator_type, s.value, b.gni, round(b.gni_pc, 6) AS gni_pc
    FROM (SELECT f.year, i.iso_code AS entity_code, f.indicator_type, {dbl('sum(f.value)')} AS value
        FROM flows f LEFT JOIN isos i ON f.country = i.name GROUP BY f.year, i.iso_code, f.indicator_type) s
    LEFT JOIN balances b ON b.year = s.year AND b.entity_code = s.entity_code""",
)

# --- aggregations ------------------------------------------------------------------------

register(
    "prep_flows",
    lambda t: totals.prep_flows(t.flow_rows, TRADE.world),
    f"""SELECT {FLOW}, iso_code, counterpart_iso_code, {dbl('sum(value)')} AS value FROM flow_rows
    WHERE iso_code IS NOT NULL AND value <> 0 GROUP BY {FLOW}, iso_code, counterpart_iso_code""",
)
NO_TYPE = FLOW.replace("indicator_type, ", "")
register(
    "net_flows",
    lambda t: totals.net_flows(t.flows),
    f"SELECT {NO_TYPE}, 'net_flow' AS indicator_type, {dbl('sum(value)')} AS value FROM flows GROUP BY {NO_TYPE}",
)
register(
    "by_country",
    lambda t: totals.by_country(t.flows),
    f"SELECT {GROUPER}, {dbl('sum(value)')} AS value FROM flows GROUP BY {GROUPER}",
)
COUNTRY_SUMS = f"(SELECT {GROUPER}, sum(value) AS value FROM flows GROUP BY {GROUPER})"
register(
    "world_total",
    lambda t: totals.append_world_total(totals.by_country(t.flows), "World"),
    f"""SELECT {GROUPER}, {dbl('value')} AS value FROM {COUNTRY_SUMS}
    UNION ALL SELECT year, 'World', NULL, NULL, prices, indicator_type, {dbl('sum(value)')}
    FROM flows GROUP BY year, prices, indicator_type""",
)
register(
    "group_totals",
    lambda t: totals.append_group_totals(totals.by_country(t.flows), "income_level", ["continent"]),
    f"""SELECT {GROUPER}, {dbl('value')} AS value FROM {COUNTRY_SUMS}
    UNION ALL SELECT year, income_level, NULL, income_level, prices, indicator_type, {dbl('sum(value)')}
    FROM flows WHERE income_level IS NOT NULL GROUP BY year, income_level, prices, indicator_type""",
)
GROUP_NAMES = tuple(GROUPS)
register(
    "groupings",
    lambda t: totals.group_summary(totals.by_country(t.flows), GROUPS, TRADE.developing),
    f"""SELECT {GROUPER}, {dbl('sum(value)')} AS value FROM (
        SELECT year, 'Developing countries' AS country, CAST(NULL AS VARCHAR) AS continent,
            CAST(NULL AS VARCHAR) AS income_level, prices, indicator_type, value FROM flows
        UNION ALL SELECT year, continent, continent, NULL, prices, indicator_type, value FROM flows
        UNION ALL SELECT year, income_level, NULL, income_level, prices, indicator_type, value FROM flows)
    WHERE country IN {GROUP_NAMES} GROUP BY {GROUPER}""",
)
register(
    "dev_total",
    lambda t: totals.developing_total(t.flows, TRADE.developing),
    f"""SELECT year, 'Developing countries' AS country, 'World' AS continent, 'All' AS income_level,
        counterpart_area, counterpart_type, indicator, indicator_type, prices, {dbl('sum(value)')} AS value
    FROM flows GROUP BY ALL""",
)
register(
    "exclusions",
    lambda t: fl.exclusions(t.flows.where("year <= 2000"), TRADE, True, True, True),
    f"""SELECT year, country, continent, income_level, counterpart_type, indicator, indicator_type, prices,
        {dbl('value')} AS value FROM china""",
)


def _by_type(t: Trade) -> DataFrame:
    """Net-flow rows before the group rows are appended."""
    rows = reports.net_flows_by_country(t.flows, TRADE, as_net_flows=False)
    return rows.withColumn("flow_type", F.lit("all"))


BY_TYPE = "(SELECT *, 'all' AS flow_type FROM net_all)"
NET_TABLE = f"SELECT {GROUPER}, flow_type, {dbl('value')} AS value FROM {BY_TYPE}"
register(
    "income_aggs_net",
    lambda t: totals.append_income_levels(_by_type(t), TRADE.developing),
    f"""{NET_TABLE} UNION ALL SELECT year, income_level, NULL, NULL, prices, indicator_type, flow_type, {dbl('sum(value)')}
    FROM {BY_TYPE} WHERE country <> 'Developing countries' AND income_level <> 'High income'
    GROUP BY year, income_level, prices, indicator_type, flow_type""",
)
register(
    "africa_agg_net",
    lambda t: totals.append_africa(_by_type(t), TRADE.africa),
    f"""{NET_TABLE} UNION ALL SELECT year, 'AFRICA', NULL, NULL, prices, indicator_type, flow_type, {dbl('sum(value)')}
    FROM {BY_TYPE} WHERE continent = 'AFRICA' GROUP BY year, prices, indicator_type, flow_type""",
)


def _factors(t: Trade) -> DataFrame:
    oda = joins.add_iso_codes(t.projections.transform(sc.select_family, "oda"), t.isos, "donor")
    return sc.multipliers(oda, t.projection_deflators, TRADE.latest_year)


def _latest(t: Trade) -> DataFrame:
    return sr.latest_inflows(t.flows, TRADE)


def _inflow_scenarios(t: Trade, scenarios: Sequence[sc.Scenario] = SCENARIOS) -> DataFrame:
    return sr.inflow_scenarios(_latest(t), t.isos, _factors(t), TRADE, scenarios)


def _estimates(t: Trade) -> DataFrame:
    return reports.projected_outflows(t.flows, TRADE)


def _scenario_pairs(t: Trade) -> DataFrame:
    ahead = _inflow_scenarios(t).where("year <> 2000").drop("indicator_type").withColumnRenamed("value", "inflows")
    return joins.natural_left_join(ahead, _estimates(t).drop("indicator_type").withColumnRenamed("value", "outflows"))


PAIRS = "year, country, continent, income_level, prices, scenario"
PAIR_VALUES = f"{cents('inflows')} AS inflows, {cents('outflows')} AS outflows"
PAIR_SUMS = f"{cents('coalesce(sum(inflows), 0)')}, {cents('coalesce(sum(outflows), 0)')}"
register(
    "income_aggs_scen",
    lambda t: totals.append_scenario_income_levels(_scenario_pairs(t), TRADE.developing).transform(to_cents, "inflows", "outflows"),
    f"""SELECT {PAIRS}, {PAIR_VALUES} FROM scenario_pairs
    UNION ALL SELECT year, income_level, NULL, NULL, 'current', scenario, {PAIR_SUMS} FROM scenario_pairs
    WHERE country <> 'Developing countries' AND income_level <> 'High income' GROUP BY year, income_level, scenario""",
)
register(
    "africa_agg_scen",
    lambda t: totals.append_scenario_africa(_scenario_pairs(t), TRADE.africa).transform(to_cents, "inflows", "outflows"),
    f"""SELECT {PAIRS}, {PAIR_VALUES} FROM scenario_pairs
    UNION ALL SELECT year, continent, NULL, NULL, 'current', scenario, {PAIR_SUMS} FROM scenario_pairs
    WHERE continent = 'AFRICA' GROUP BY year, continent, scenario""",
)


def _service(t: Trade) -> DataFrame:
    return reports.debt_service_report(t.flows, TRADE, china_as_counterpart_type=True)


SERVICE = "year, country, continent, income_level, counterpart_type, prices"
register(
    "income_aggs_cp",
    lambda t: totals.append_counterpart_income_levels(_service(t), TRADE.developing),
    f"""SELECT {SERVICE}, CAST(NULL AS VARCHAR) AS period, {dbl('value')} AS value FROM service
    UNION ALL SELECT year, income_level, NULL, NULL, counterpart_type, 'current', NULL, {dbl('sum(value)')} FROM service
    WHERE country <> 'Developing countries' AND income_level <> 'High income' GROUP BY year, income_level, counterpart_type""",
)
register(
    "africa_agg_cp",
    lambda t: totals.append_counterpart_africa(_service(t), TRADE.africa),
    f"""SELECT {SERVICE}, CAST(NULL AS VARCHAR) AS period, {dbl('value')} AS value FROM service
    UNION ALL SELECT year, continent, NULL, NULL, counterpart_type, 'current', NULL, {dbl('sum(value)')} FROM service
    WHERE continent = 'AFRICA' GROUP BY year, continent, counterpart_type""",
)
register(
    "inflows_by_period",
    lambda t: periods.average_by_period(reports.inflows_table(t.flows, TRADE), PERIODS),
    f"""SELECT period, country, continent, income_level, prices, counterpart_type,
        CASE WHEN period = '1997-1999' THEN {half_even('total', 3)} ELSE {half_even('total', 2)} END AS value
    FROM (SELECT CASE WHEN year <= 1996 THEN '1995-1996' WHEN year <= 1999 THEN '1997-1999' ELSE '2000-2001' END AS period,
        country, continent, income_level, prices, counterpart_type, sum(value) AS total
        FROM (SELECT * EXCLUDE (period) FROM inflow_table) GROUP BY ALL)""",
)
register(
    "debt_by_period",
    lambda t: periods.average_by_period(reports.debt_service_table(t.flows, TRADE), PERIODS),
    "SELECT * FROM service_averages",
)
register(
    "dac_total",
    lambda t: totals.append_dac_total(t.aid),
    f"""SELECT year, donor_code, donor_name, currency, prices, indicator, {dbl('value')} AS value FROM aid_total
    UNION ALL SELECT year, 20001, 'DAC Countries', currency, prices, indicator, {dbl('sum(value)')} FROM aid_total
    GROUP BY year, currency, prices, indicator""",
)
register("latest_inflows", _latest, f"SELECT {FLOW}, {dbl('value')} AS value FROM latest")

# --- series ------------------------------------------------------------------------------

INDEX = "iso_code, year, round(value, 8) AS value"
register(
    "growth_rate",
    lambda t: t.series("NGDP").transform(series.growth_rate).transform(rounded, 8, "value"),
    f"SELECT {INDEX} FROM growth WHERE indicator = 'NGDP'",
)
register(
    "growth_rate_nan",
    lambda t: t.series("NGDP").withColumn("value", F.when(F.col("year") % 3 == 0, float("nan")).otherwise(F.col("value")))
    .transform(series.growth_rate).transform(rounded, 8, "value"),
    """SELECT iso_code, year, round(value, 8) AS value FROM (
        SELECT iso_code, year, known / nullif(lag(known) OVER (PARTITION BY iso_code ORDER BY year), 0) - 1 AS value FROM (
            SELECT iso_code, year, last_value(CASE WHEN year % 3 <> 0 THEN value END IGNORE NULLS) OVER (
                PARTITION BY iso_code ORDER BY year ROWS UNBOUNDED PRECEDING) AS known
            FROM macro WHERE indicator = 'NGDP' AND iso_code IS NOT NULL)) WHERE value IS NOT NULL""",
)
register(
    "cum_deflator",
    lambda t: t.series("NGDP").transform(series.growth_rate).transform(series.cumulative_growth)
    .transform(rounded, 8, "value"),
    f"SELECT {INDEX} FROM cumulated WHERE indicator = 'NGDP'",
)
register(
    "rebase",
    lambda t: series.rebase(t.series("NGDPD"), BASE_YEAR).transform(rounded, 8, "value"),
    f"SELECT {INDEX} FROM rebased WHERE indicator = 'NGDPD' AND iso_code IS NOT NULL",
)
register(
    "gdp_index",
    lambda t: totals.union_by_name(*[
        series.growth_index(t.series(i), BASE_YEAR).withColumn("indicator", F.lit(i)) for i in ("NGDP", "NGDP_R")
    ]).transform(rounded, 8, "value"),
    f"SELECT indicator, {INDEX} FROM indices WHERE indicator IN ('NGDP', 'NGDP_R')",
)
register(
    "price_deflator",
    lambda t: series.price_deflator(t.series("NGDP_D"), BASE_YEAR).transform(rounded, 8, "value"),
    f"SELECT {INDEX} FROM rebased WHERE indicator = 'NGDP_D' AND iso_code IS NOT NULL",
)
register(
    "exchange_deflator",
    lambda t: _exchange(t).transform(rounded, 8, "exchange_deflator"),
    "SELECT year, iso_code, round(exchange_deflator, 8) AS exchange_deflator FROM exchange",
)


def _exchange(t: Trade) -> DataFrame:
    return series.exchange_deflator(t.series("NGDP"), t.series("NGDPD"), BASE_YEAR)


def _extended(mode: str) -> Callable[[Trade], DataFrame]:
    return lambda t: series.extend_series(t.series("NGDP"), 2006, 3, mode).transform(rounded, 4, "value")


def _extend_sql(extra: str) -> str:
    return f"""WITH s AS (SELECT iso_code, year, value, value - lag(value) OVER (PARTITION BY iso_code ORDER BY year) AS d,
        max(year) OVER (PARTITION BY iso_code) AS top FROM macro WHERE indicator = 'NGDP' AND iso_code IS NOT NULL),
    m AS (SELECT iso_code, top,
        CASE WHEN count(d) FILTER (year > top - 3) = 3 THEN sum(d) FILTER (year > top - 3) / 3 END AS m,
        CASE WHEN count(d) FILTER (year BETWEEN top - 3 AND top - 1) = 3
            THEN sum(d) FILTER (year BETWEEN top - 3 AND top - 1) / 3 END AS m_prev,
        arg_max(value, year) FILTER (value IS NOT NULL AND year >= top - 3) AS last FROM s GROUP BY iso_code, top)
    SELECT iso_code, year, round(value, 4) AS value FROM s
    UNION ALL SELECT iso_code, CAST(top + k.range AS INTEGER),
        round(last + {extra} + k.range * coalesce(m, m_prev), 4)
    FROM m, range(1, 20) k WHERE top + k.range <= 2006"""


def _register_extension(key: str, mode: str, extra: str) -> None:
    QUERIES[key] = lambda spark, folder: finish(_extended(mode)(trade(spark, folder)))
    # The CTEs of the body join the shared ones.
    shared = query("SELECT * FROM macro")
    head = shared[: shared.rindex(" SELECT * FROM macro")]
    ORACLES[key] = head + ", " + _extend_sql(extra)[len("WITH "):]


_register_extension("extend_series", "published", "coalesce(m_prev, 0)")
_register_extension("extend_series_clean", "clean", "0")
register(
    "future_gni",
    lambda t: series.future_gni(t.donor_gni("current"), series.growth_index(t.series("NGDP"), BASE_YEAR), "current")
    .transform(rounded, 3, "current_usd_gni"),
    """SELECT year, iso_code, round(current_usd_gni, 3) AS current_usd_gni FROM gni_current WHERE year > 1998""",
)
register(
    "current_series",
    lambda t: series.current_series(t.donor_gni("current"), series.growth_index(t.series("NGDP"), BASE_YEAR))
    .transform(rounded, 3, "current_usd_gni").transform(rounded, 8, "lcu_lcu_deflator"),
    """SELECT g.year, g.iso_code, round(g.current_usd_gni, 3) AS current_usd_gni, round(x.value, 8) AS lcu_lcu_deflator
    FROM gni_current g LEFT JOIN indices x ON x.indicator = 'NGDP' AND x.iso_code = g.iso_code AND x.year = g.year""",
)
register(
    "year_iso_grid",
    lambda t: series.year_iso_grid(t.series("NGDP"), 1995, 2004),
    """SELECT CAST(y.range AS INTEGER) AS year, i.iso_code FROM range(1995, 2005) y,
        (SELECT DISTINCT iso_code FROM macro WHERE indicator = 'NGDP' AND iso_code IS NOT NULL) i""",
)


def _constant_series(t: Trade) -> DataFrame:
    return series.constant_series(
        t.donor_gni("constant"), series.growth_index(t.series("NGDP_R"), BASE_YEAR),
        t.iso_deflators("NGDPD"), t.iso_deflators("NGDP_D"), _exchange(t), 1995, 2004, 1999,
    )


register(
    "constant_series",
    _constant_series,
    """SELECT u.year, u.iso_code, round(u.usd, 4) AS usd_usd_deflator, round(l.lcu, 4) AS lcu_lcu_deflator,
        round_even(g.constant_usd_gni, 4) AS constant_usd_gni
    FROM (SELECT year, iso_code, 100 * value AS usd FROM rebased WHERE indicator = 'NGDPD' AND year <= 1999
        UNION ALL SELECT r.year, r.iso_code, 100 * (100 * r.value) / e.exchange_deflator
        FROM rebased r JOIN exchange e ON e.year = r.year AND e.iso_code = r.iso_code
        WHERE r.indicator = 'NGDP_D' AND r.year > 1999 AND r.value IS NOT NULL) u
    LEFT JOIN (SELECT year, iso_code, 100 * value AS lcu FROM rebased WHERE indicator = 'NGDP_D' AND value IS NOT NULL) l
        ON l.year = u.year AND l.iso_code = u.iso_code
    LEFT JOIN gni_constant g ON g.year = u.year AND g.iso_code = u.iso_code
    WHERE u.usd IS NOT NULL AND u.iso_code IN (SELECT iso_code FROM gni_constant)""",
)
register(
    "deflate",
    lambda t: series.to_constant_prices(_debtor_sums(t), t.iso_deflators("NGDP_D")).transform(to_cents),
    f"""SELECT s.year, s.iso_code, s.indicator_type, 'constant' AS prices,
        {cents('CAST(s.value AS DOUBLE) / (100 * r.value / 100)')} AS value
    FROM (SELECT f.year, i.iso_code, f.indicator_type, sum(f.value) AS value
        FROM flows f LEFT JOIN isos i ON f.country = i.name GROUP BY ALL) s
    LEFT JOIN rebased r ON r.indicator = 'NGDP_D' AND r.iso_code = s.iso_code AND r.year = s.year""",
)
CURRENCY_PAIRS = [
    series.Currencies(source, target, back)
    for source, target in (("LCU", "LCU"), ("LCU", "USD"), ("USD", "LCU"), ("USD", "USD"), ("N05", "USD"), ("LCU", "N05"))
    for back in (False, True)
]


def _rates(t: Trade) -> DataFrame:
    dollars = t.series("NGDPD").select("iso_code", "year", F.col("value").alias("dollars"))
    exchange = t.series("NGDP").join(dollars, ["iso_code", "year"]).select("iso_code", "year", F.try_divide("dollars", "value").alias("rate"))
    return series.currency_rates(t.iso_deflators("NGDP_D"), exchange, BASE_YEAR)


register(
    "deflate_currency",
    lambda t: series.deflate_between(_debtor_sums(t), _rates(t), CURRENCY_PAIRS).transform(to_cents),
    f"""SELECT s.year, s.iso_code, s.indicator_type, p.source AS source_currency, p.target AS target_currency, p.back AS to_current,
        {cents("""CAST(s.value AS DOUBLE) * power(
            CASE p.source WHEN 'LCU' THEN 1 WHEN 'USD' THEN 1 / x.rate ELSE c.rate / x.rate END
            * CASE p.target WHEN 'LCU' THEN 1 WHEN 'USD' THEN b.rate ELSE b.rate / k.rate END / x.price, CASE WHEN p.back THEN -1 ELSE 1 END)""")} AS value
    FROM (SELECT f.year, i.iso_code, f.indicator_type, sum(f.value) AS value
        FROM flows f LEFT JOIN isos i ON f.country = i.name GROUP BY ALL) s
    CROSS JOIN (SELECT * FROM (VALUES ('LCU', 'LCU'), ('LCU', 'USD'), ('USD', 'LCU'), ('USD', 'USD'), ('N05', 'USD'), ('LCU', 'N05')) a(source, target),
        (VALUES (FALSE), (TRUE)) b(back)) p
    LEFT JOIN (SELECT r.iso_code, r.year, r.value AS price, d.value / n.value AS rate FROM rebased r
        LEFT JOIN macro d ON d.indicator = 'NGDPD' AND d.iso_code = r.iso_code AND d.year = r.year
        LEFT JOIN macro n ON n.indicator = 'NGDP' AND n.iso_code = r.iso_code AND n.year = r.year
        WHERE r.indicator = 'NGDP_D') x ON x.iso_code = s.iso_code AND x.year = s.year
    LEFT JOIN (SELECT d.iso_code, d.year, d.value / n.value AS rate FROM macro d JOIN macro n ON d.iso_code = n.iso_code AND d.year = n.year
        WHERE d.indicator = 'NGDPD' AND n.indicator = 'NGDP' AND d.year = 1998) b ON b.iso_code = s.iso_code
    LEFT JOIN (SELECT d.year, d.value / n.value AS rate FROM macro d JOIN macro n ON d.iso_code = n.iso_code AND d.year = n.year
        WHERE d.indicator = 'NGDPD' AND n.indicator = 'NGDP' AND d.iso_code = 'N05') c ON c.year = s.year
    LEFT JOIN (SELECT d.value / n.value AS rate FROM macro d JOIN macro n ON d.iso_code = n.iso_code AND d.year = n.year
        WHERE d.indicator = 'NGDPD' AND n.indicator = 'NGDP' AND d.iso_code = 'N05' AND d.year = 1998) k ON TRUE""",
)
register(
    "aid_gni",
    lambda t: t.donor_gni("constant"),
    "SELECT year, iso_code, constant_value AS value FROM donor_gni",
)

# --- scenarios ---------------------------------------------------------------------------


def _recent(t: Trade) -> DataFrame:
    """Inflows by country and indicator up to the latest year."""
    rows = t.flows.where("indicator_type = 'inflow' and year <= 2000")
    return rows.groupBy("year", "country", "indicator").agg(totals.total("value").alias("value"))


RECENT = """(SELECT year, country, indicator, sum(value) AS value FROM flows
    WHERE indicator_type = 'inflow' AND year <= 2000 GROUP BY ALL)"""
AHEAD = f"""(SELECT r.* REPLACE (CAST(y.range AS INTEGER) AS year), y.range > 2000 AND (r.indicator LIKE 'grants%'
    OR r.indicator IN ('bilateral_concessional', 'multilateral_concessional')) AS cut
    FROM {RECENT} r, range(1995, 2005) y WHERE y.range = r.year OR (r.year = 2000 AND y.range > 2000))"""
CUT_60 = "CAST(CAST(value AS DOUBLE) * (1 - 60::DOUBLE / 100 * ((year - 2000) / 4)) AS DECIMAL(38,8))"
register(
    "project_linear",
    lambda t: sc.project_linear(_recent(t), "concessional_finance", 60, TRADE.target_year).transform(to_cents),
    f"""SELECT year, country, indicator, {cents(f'CASE WHEN cut THEN {CUT_60} ELSE CAST(value AS DECIMAL(38,8)) END')} AS value FROM {AHEAD}""",
)
register(
    "project_oda_linear",
    lambda t: sc.project_linear(_recent(t), None, 60, TRADE.target_year).transform(to_cents),
    f"""SELECT year, country, indicator, {cents(f'CASE WHEN year > 2000 THEN {CUT_60} ELSE CAST(value AS DECIMAL(38,8)) END')} AS value FROM {AHEAD}""",
)


def _recent_coded(t: Trade) -> DataFrame:
    return joins.add_iso_codes(_recent(t), t.isos, "country")


def _multiplied(applies: str) -> str:
    return f"""SELECT a.year, a.country, a.indicator, i.iso_code, round(f.realistic_multiplier, 8) AS realistic_multiplier,
        {cents(f"CASE WHEN {applies} AND f.iso_code IS NOT NULL THEN CAST(CAST(a.value AS DOUBLE) * f.realistic_multiplier AS DECIMAL(38,8)) ELSE CAST(a.value AS DECIMAL(38,8)) END")} AS value
    FROM {AHEAD} a LEFT JOIN isos i ON a.country = i.name
    LEFT JOIN factors f ON f.iso_code = i.iso_code AND f.year = a.year"""


register(
    "project_mult",
    lambda t: sc.project_with_multiplier(_recent_coded(t), _factors(t), "grants", target_year=TRADE.target_year)
    .transform(rounded, 8, "realistic_multiplier").transform(to_cents),
    _multiplied("a.indicator LIKE 'grants%'"),
)
register(
    "project_oda_mult",
    lambda t: sc.project_with_multiplier(_recent_coded(t), _factors(t), None, target_year=TRADE.target_year)
    .transform(rounded, 8, "realistic_multiplier").transform(to_cents),
    _multiplied("TRUE"),
)
register(
    "multipliers",
    lambda t: _factors(t).transform(rounded, 8, "realistic_multiplier"),
    "SELECT year, iso_code, donor, round(realistic_multiplier, 8) AS realistic_multiplier FROM factors",
)
register(
    "ramp_multiplier",
    lambda t: sc.ramp_multiplier(_factors(t), 0.1, 2002, 2004).transform(
        rounded, 8, "realistic_multiplier", "realistic_multiplier_reduced"
    ),
    """SELECT year, iso_code, donor, round(realistic_multiplier, 8) AS realistic_multiplier,
        round(realistic_multiplier - CASE WHEN year < 2002 THEN 0 WHEN year > 2004 THEN 0.1::DOUBLE
            ELSE 0.1::DOUBLE * ((year - 2001) / 3) END, 8) AS realistic_multiplier_reduced FROM factors""",
)
register(
    "extend_year",
    lambda t: sc.extend_year(_recent(t), 2000, 2001),
    f"""SELECT year, country, indicator, {dbl('value')} AS value FROM {RECENT}
    UNION ALL SELECT 2001, country, indicator, {dbl('value')} FROM {RECENT} WHERE year = 2000""",
)
for _scenario in SCENARIOS:
    _n = _scenario.name[-1]
    register(
        f"scenario_{_n}",
        lambda t, s=_scenario: _inflow_scenarios(t, [s]).drop("scenario").transform(to_cents),
        f"SELECT {GROUPER}, {cents('value')} AS value FROM scen{_n}",
    )
for _scenario in SCENARIOS[1:]:
    _n = _scenario.name[-1]
    register(
        f"oda_scenario_{_n}",
        lambda t, s=_scenario: sr.aid_scenario(t.aid, t.isos, _factors(t), TRADE, s).transform(to_cents),
        f"""SELECT year, donor_code, donor_name, currency, prices, indicator, iso_code, {cents('value')} AS value
        FROM aid_dac{_n}""",
    )
register("projected_outflows", _estimates, f"SELECT {GROUPER}, {dbl('value')} AS value FROM estimates")

# --- orders and set operations -----------------------------------------------------------

FIRST_NATIONS = ("NATION_8", "NATION_12")
register(
    "custom_sort",
    lambda t: totals.by_country(t.flows).withColumn("place", reshape.list_order("country", FIRST_NATIONS)[0])
    .transform(reshape.with_rank, [*reshape.list_order("country", FIRST_NATIONS), F.col("year"), F.col("indicator_type")]),
    ranked(f"""SELECT {GROUPER}, {dbl('sum(value)')} AS value, CASE country WHEN 'NATION_8' THEN 0 WHEN 'NATION_12' THEN 1 ELSE 2 END AS place
    FROM flows GROUP BY {GROUPER}""", "place, country, year, indicator_type"),
)
register(
    "reorder",
    lambda t: totals.group_summary(totals.by_country(t.flows), GROUPS, TRADE.developing)
    .withColumn("place", masks.rank_in("country", GROUPS, 99))
    .transform(reshape.with_rank, [*reshape.country_order(GROUPS), F.col("indicator_type")]),
    ranked(f"""SELECT g.*, CASE country {' '.join(f"WHEN '{k}' THEN {v}" for k, v in GROUPS.items())} ELSE 99 END AS place FROM (
    SELECT {GROUPER}, {dbl('sum(value)')} AS value FROM (
        SELECT year, 'Developing countries' AS country, CAST(NULL AS VARCHAR) AS continent,
            CAST(NULL AS VARCHAR) AS income_level, prices, indicator_type, value FROM flows
        UNION ALL SELECT year, continent, continent, NULL, prices, indicator_type, value FROM flows
        UNION ALL SELECT year, income_level, NULL, income_level, prices, indicator_type, value FROM flows)
    WHERE country IN {GROUP_NAMES} GROUP BY {GROUPER}) g""", "place, country, year, indicator_type"),
)
register(
    "union_flows",
    lambda t: totals.union_by_name(
        totals.by_country(t.flows).drop("continent"), totals.net_flows(totals.by_country(t.flows))
    ),
    f"""SELECT year, country, NULL AS continent, income_level, prices, indicator_type, {dbl('value')} AS value FROM {COUNTRY_SUMS}
    UNION ALL SELECT year, country, continent, income_level, prices, 'net_flow', {dbl('sum(value)')}
    FROM flows GROUP BY year, country, continent, income_level, prices""",
)

# --- flows from the raw sources ----------------------------------------------------------

CLEAN = "year, iso_code, country, continent, counterpart_area, counterpart_iso_code, income_level, indicator, counterpart_type, prices"
register(
    "clean_grants",
    lambda t: fl.clean_grants(t.aid_raw, t.sources),
    f"SELECT {CLEAN}, {dbl('value')} AS value FROM grants",
)
register(
    "grants_inflows",
    lambda t: fl.grants_inflows(t.sources, TRADE, constant=True),
    f"SELECT {CLEAN}, {dbl('value')} AS value FROM grants WHERE prices = 'constant' AND year <= 2000",
)


def _clean_debt(t: Trade) -> DataFrame:
    coded = concessional.debt_by_indicator(t.debt_raw.where("year < timestamp_ntz'2001-01-01'"), DISBURSEMENT_CODES)
    return fl.clean_debt(coded, t.sources)


register(
    "clean_debt",
    _clean_debt,
    f"SELECT {CLEAN.replace(', prices', '')}, {dbl('value')} AS value FROM clean_inflow_legs",
)
register(
    "debt_inflows",
    lambda t: fl.debt_inflows(t.sources, TRADE),
    f"SELECT {CLEAN}, {dbl('value')} AS value FROM clean_inflow_legs",
)
register(
    "debt_inflows_constant",
    lambda t: fl.debt_inflows(t.sources, TRADE, constant=True).transform(to_cents),
    f"""SELECT {', '.join('l.' + c for c in CLEAN.replace(', prices', '').split(', '))}, 'constant' AS prices,
        {cents('CAST(l.value AS DOUBLE) / (100 * r.value / 100)')} AS value
    FROM clean_inflow_legs l LEFT JOIN rebased r ON r.indicator = 'NGDP_D' AND 'ISO_' || r.k = l.iso_code AND r.year = l.year""",
)
register(
    "debt_service_raw",
    lambda t: fl.debt_service(t.sources, TRADE),
    f"SELECT {CLEAN}, indicator_type, {dbl('value')} AS value FROM clean_service_legs",
)
TOTAL_INFLOWS = f"""(SELECT {CLEAN}, value FROM clean_inflow_legs UNION ALL
    SELECT {CLEAN}, value FROM grants WHERE prices = 'current' AND year <= 2000)"""
register(
    "total_inflows",
    lambda t: fl.total_inflows(t.sources, TRADE),
    f"SELECT {CLEAN}, 'inflow' AS indicator_type, {dbl('value')} AS value FROM {TOTAL_INFLOWS}",
)
SLIM = "year, country, continent, counterpart_area, income_level, indicator, counterpart_type, prices"


def _all_flows_sql(inflows: str, service: str, value: str) -> str:
    return f"""SELECT {SLIM}, indicator_type, {value} AS value FROM (
        SELECT {SLIM}, iso_code, counterpart_iso_code, 'inflow' AS indicator_type, value FROM {inflows}
        UNION ALL SELECT {SLIM}, iso_code, counterpart_iso_code, indicator_type, -value FROM {service})
    WHERE iso_code IS NOT NULL AND counterpart_area <> 'World'
    GROUP BY {SLIM}, iso_code, counterpart_iso_code, indicator_type HAVING sum(value) <> 0"""


def _real(legs: str, *more: str) -> str:
    """Legs in constant prices, as the flow table has them: eight digits."""
    kept = ", ".join([*("l." + c for c in CLEAN.replace(", prices", "").split(", ")), *("l." + c for c in more)])
    return f"""(SELECT {kept}, 'constant' AS prices, CAST(CAST(l.value AS DOUBLE) / (100 * r.value / 100) AS DECIMAL(38,8)) AS value
        FROM {legs} l LEFT JOIN rebased r ON r.indicator = 'NGDP_D' AND 'ISO_' || r.k = l.iso_code AND r.year = l.year)"""


CONSTANT_INFLOWS = f"""(SELECT {CLEAN}, value FROM {_real('clean_inflow_legs')} UNION ALL
    SELECT {CLEAN}, CAST(value AS DECIMAL(38,8)) FROM grants WHERE prices = 'constant' AND year <= 2000)"""
register("all_flows", lambda t: fl.all_flows(t.sources, TRADE), _all_flows_sql(TOTAL_INFLOWS, "clean_service_legs", dbl("sum(value)")))
register(
    "total_inflows_constant",
    lambda t: fl.total_inflows(t.sources, TRADE, constant=True).transform(to_cents),
    f"SELECT {CLEAN}, 'inflow' AS indicator_type, {cents('value')} AS value FROM {CONSTANT_INFLOWS}",
)
CONSTANT_FLOWS = _all_flows_sql(CONSTANT_INFLOWS, _real("clean_service_legs", "indicator_type"), "sum(value)")
register(
    "all_flows_constant",
    lambda t: fl.all_flows(t.sources, TRADE, constant=True).transform(to_cents),
    f"SELECT * REPLACE ({cents('value')} AS value) FROM ({CONSTANT_FLOWS})",
)


register(
    "flows_by_version",
    lambda t: fl.flows_by_version(t.flow_table, TRADE, version="excluding_concessional_finance", as_net_flows=True),
    f"SELECT {NO_TYPE}, 'net_flow' AS indicator_type, {dbl('sum(value)')} AS value FROM kept_market GROUP BY {NO_TYPE}",
)

register(
    "net_flows_report_constant",
    lambda t: reports.net_flows_report(fl.all_flows(t.sources, TRADE, constant=True), TRADE).transform(to_cents),
    f"SELECT {GROUPER}, flow_type, {cents('value')} AS value FROM report",
    flows=CONSTANT_FLOWS,
)
register(
    "net_flows_by_country_constant",
    lambda t: reports.net_flows_by_country(fl.all_flows(t.sources, TRADE, constant=True), TRADE, as_net_flows=False).transform(to_cents),
    f"SELECT {GROUPER}, {cents('value')} AS value FROM net_all",
    flows=CONSTANT_FLOWS,
)

# --- reports -----------------------------------------------------------------------------

register(
    "net_flows_by_country",
    lambda t: reports.net_flows_by_country(t.flows, TRADE, "excluding_concessional_finance"),
    f"""SELECT year, country, continent, income_level, prices, 'net_flow' AS indicator_type, {dbl('sum(value)')} AS value
    FROM net_market GROUP BY year, country, continent, income_level, prices""",
)
register(
    "net_flows_without_grants",
    lambda t: reports.net_flows_by_country(t.flows, TRADE, "excluding_grants"),
    f"""SELECT year, country, continent, income_level, prices, 'net_flow' AS indicator_type, {dbl('sum(value)')} AS value FROM (
        SELECT year, country, continent, income_level, prices, value FROM no_grants
        UNION ALL SELECT year, 'Developing countries', 'World', 'All', prices, value FROM no_grants)
    GROUP BY year, country, continent, income_level, prices""",
)


def _report(t: Trade) -> DataFrame:
    return reports.net_flows_report(t.flows, TRADE)


register("net_flows_report", _report, f"SELECT {GROUPER}, flow_type, {dbl('value')} AS value FROM report")
register(
    "historical_inflows",
    lambda t: reports.historical_inflows(t.flows, TRADE, debt_only=True, china_as_counterpart_type=True),
    f"""SELECT year, country, continent, income_level, counterpart_type, indicator_type, prices, {dbl('value')} AS value FROM hist""",
)
register(
    "historical_inflows_all_countries",
    lambda t: reports.historical_inflows(t.flows, TRADE, version="excluding_grants", exclude_outliers=False, remove_countries_wo_outflows=False),
    f"""SELECT year, country, continent, income_level, counterpart_area, counterpart_type, indicator_type, prices, {dbl('sum(value)')} AS value
    FROM (SELECT * FROM flows UNION ALL BY NAME SELECT * REPLACE ('Developing countries' AS country,
        'World' AS continent, 'All' AS income_level) FROM flows)
    WHERE indicator_type = 'inflow' AND year <= 2000 AND indicator NOT ILIKE '%grant%' AND income_level IS NOT NULL
        AND counterpart_type IS NOT NULL
    GROUP BY year, country, continent, income_level, counterpart_area, counterpart_type, indicator_type, prices""",
)
register(
    "projected_outflows_all_countries",
    lambda t: reports.projected_outflows(t.flows, TRADE, "excluding_concessional_finance", exclude_outliers=False, remove_countries_wo_outflows=False),
    f"""SELECT {GROUPER}, {dbl('sum(value)')} AS value FROM (SELECT * FROM market UNION ALL BY NAME SELECT * REPLACE (
        'Developing countries' AS country, 'World' AS continent, 'All' AS income_level) FROM market)
    WHERE indicator_type = 'outflow' AND year > 2000 GROUP BY {GROUPER}""",
)
register("debt_service", _service, f"SELECT {SERVICE}, {dbl('value')} AS value FROM service")
register(
    "debt_service_all_countries",
    lambda t: reports.debt_service_report(t.flows, TRADE, exclude_outliers=False, remove_countries_wo_outflows=False),
    f"""SELECT year, country, continent, income_level, counterpart_area, counterpart_type, prices, {dbl('-sum(value)')} AS value
    FROM (SELECT * FROM flows UNION ALL BY NAME SELECT * REPLACE ('Developing countries' AS country,
        'World' AS continent, 'All' AS income_level) FROM flows)
    WHERE indicator_type = 'outflow' AND year <= 2001
    GROUP BY year, country, continent, income_level, counterpart_area, counterpart_type, prices""",
)
register(
    "inflow_scenarios",
    lambda t: _inflow_scenarios(t).transform(to_cents),
    f"SELECT {GROUPER}, scenario, {cents('value')} AS value FROM scenario_inflows",
)


def _scenario_table(t: Trade) -> DataFrame:
    return sr.net_flow_scenarios(_inflow_scenarios(t), _estimates(t), TRADE)


register(
    "net_flow_scenarios",
    lambda t: _scenario_table(t).transform(to_cents, "inflows", "outflows", "net_flows"),
    f"""SELECT {PAIRS}, {PAIR_VALUES}, {cents('net_flows')} AS net_flows FROM scenario_table""",
)
PAIR_MEASURES = ("inflows", "outflows", "net_flows")
register(
    "unpivot",
    lambda t: reshape.unpivot(
        _scenario_table(t).transform(to_cents, *PAIR_MEASURES).transform(finish), PAIRS.split(", "), PAIR_MEASURES
    ),
    f"""SELECT {PAIRS}, unnest(['inflows', 'outflows', 'net_flows']) AS indicator,
        unnest([{cents('inflows')}, {cents('outflows')}, {cents('net_flows')}]) AS value FROM scenario_table""",
)
register(
    "oda_scenarios",
    lambda t: sr.aid_scenarios(t.aid, t.isos, _factors(t), TRADE, (sc.SCENARIO_2, SCENARIO_3))
    .transform(to_cents, *sr.AID_TITLES.values()).transform(reshape.with_rank, sr.donor_order()),
    ranked(f"""SELECT year, donor_name, currency, prices, {cents('h.value')} AS "ODA",
        CASE WHEN year >= 2001 THEN {cents('s2.value')} END AS "ODA (Projected Scenario 2)",
        CASE WHEN year >= 2001 THEN {cents('s3.value')} END AS "ODA (Projected Scenario 3)"
    FROM aid_history h
    FULL OUTER JOIN (SELECT year, donor_name, currency, prices, value FROM aid_dac2) s2 USING (year, donor_name, currency, prices)
    FULL OUTER JOIN (SELECT year, donor_name, currency, prices, value FROM aid_dac3) s3 USING (year, donor_name, currency, prices)""",
    "CASE donor_name WHEN 'DAC Countries' THEN 0 ELSE 1 END, donor_name, year"),
)

# --- charts ------------------------------------------------------------------------------


def _flow_cells(first: str, second: str) -> str:
    return f"""{dbl("max(value) FILTER (flow_type = 'all')")} AS "{first}",
        {dbl("max(value) FILTER (flow_type = 'excluding_concessional')")} AS "{second}" """


register(
    "chart_1",
    lambda t: charts.chart_1(_report(t), TRADE),
    f"""SELECT year, country, {_flow_cells('all net flows', 'net flows excluding concessional finance')}
    FROM report WHERE indicator_type = 'net_flow' GROUP BY year, country""",
)
register(
    "chart_1_download",
    lambda t: charts.chart_1(_report(t), TRADE, download=True),
    f"""SELECT year, country, {_flow_cells('net flows including aid and concessional finance',
        'net flows excluding aid and concessional finance')}, 'current US$' AS unit
    FROM report WHERE indicator_type = 'net_flow' GROUP BY year, country""",
)
TITLED = "CASE flow_type WHEN 'all' THEN 'all flows' ELSE 'excluding concessional finance' END"
SHARE = f"round({dbl('r.value')} / b.gni * 100, 8)"


def _round_share(column: str) -> Callable[[DataFrame], DataFrame]:
    return lambda d: d.withColumn(column, F.round(F.col(f"`{column}`"), 8))


def _chart_2(value: str, share: str, gni: str, gni_pc: str, expression: str) -> str:
    return f"""SELECT r.country, r.year, r.income_level, {expression} AS "{value}", {TITLED} AS flow_type,
        i.iso_code AS entity_code, b.gni AS "{gni}", {SHARE} AS "{share}", round(b.gni_pc, 6) AS "{gni_pc}"
    FROM report r JOIN isos i ON r.country = i.name
    JOIN balances b ON b.year = r.year AND b.entity_code = i.iso_code
    WHERE r.indicator_type = 'net_flow' AND r.continent = 'AFRICA' AND r.year = 2000 AND b.gni <> 0"""


ROUND_UNIT = f"round_even({dbl('r.value')} / 1e6, 2)"
register(
    "chart_2",
    lambda t: charts.chart_2(_report(t), t.isos, t.gni, t.gni_pc, TRADE, unit=UNIT)
    .transform(_round_share("value_pct_gni")).transform(rounded, 6, "gni_pc").transform(reshape.with_rank, charts.chart_2_order()),
    ranked(_chart_2("value", "value_pct_gni", "gni", "gni_pc", ROUND_UNIT), "flow_type, gni_pc, country"),
)
register(
    "chart_2_download",
    lambda t: charts.chart_2(_report(t), t.isos, t.gni, t.gni_pc, TRADE, download=True)
    .transform(_round_share(charts.NET_OF_GNI)).transform(
        lambda d: d.withColumn(charts.GNI_PC_TITLE, F.round(F.col(f"`{charts.GNI_PC_TITLE}`"), 6))
    ),
    _chart_2(charts.NET_TITLE, charts.NET_OF_GNI, charts.GNI_TITLE, charts.GNI_PC_TITLE, dbl("r.value")),
)


def _cells(column: str, labels: Sequence[str]) -> str:
    return ", ".join(f"""{dbl(f"max(value) FILTER ({column} = '{c}')")} AS "{c}" """ for c in labels)


register(
    "inflows_table",
    lambda t: reports.inflows_table(t.flows, TRADE),
    f"""SELECT year, country, continent, income_level, counterpart_type, indicator_type, prices, period,
        {dbl('value')} AS value FROM inflow_table""",
)
register(
    "debt_service_table",
    lambda t: reports.debt_service_table(t.flows, TRADE),
    f"SELECT {SERVICE}, period, {dbl('value')} AS value FROM service_table",
)
register(
    "chart_3",
    lambda t: charts.chart_3(reports.inflows_table(t.flows, TRADE), HISTORY_TYPES, TRADE),
    f"SELECT year, country, {_cells('counterpart_type', HISTORY_TYPES)} FROM inflow_table GROUP BY year, country",
)
register(
    "chart_3_download",
    lambda t: charts.chart_3(reports.inflows_table(t.flows, TRADE), HISTORY_TYPES, TRADE, download=True),
    f"""SELECT year, country, 'current' AS prices, {_cells('counterpart_type', HISTORY_TYPES)}
    FROM inflow_table GROUP BY year, country""",
)


def _averages(t: Trade) -> DataFrame:
    return periods.average_by_period(reports.debt_service_table(t.flows, TRADE), PERIODS)


CODED = """(SELECT *, counterpart_type || ' data' AS code FROM service_averages WHERE period IN ('1995-1996', '1997-1999')
    UNION ALL SELECT *, counterpart_type FROM service_averages WHERE period IN ('1997-1999', '2000-2001'))"""
register(
    "chart_4",
    lambda t: charts.chart_4(_averages(t), SERVICE_TYPES, TRADE),
    f"""SELECT country, period, counterpart_type, {', '.join(
        f"max(value) FILTER (code = '{c}') AS " + f'"{c}"' for x in SERVICE_TYPES for c in (x, x + ' data')
    )} FROM {CODED} GROUP BY country, period, counterpart_type""",
)
register(
    "chart_4_download",
    lambda t: charts.chart_4_download(_averages(t)),
    "SELECT period, country, counterpart_type, prices, value FROM service_averages",
)
register(
    "chart_5",
    lambda t: charts.chart_5(_report(t), _scenario_table(t), TRADE)
    .transform(to_cents, "all net flows", "optimistic", "realistic", "pessimistic"),
    f"""SELECT year, country, {cents("max(value) FILTER (scenario = 'all net flows')")} AS "all net flows",
        {cents("max(value) FILTER (scenario = 'scenario 1')")} AS optimistic,
        {cents("max(value) FILTER (scenario = 'scenario 2')")} AS realistic,
        {cents("max(value) FILTER (scenario = 'scenario 3')")} AS pessimistic
    FROM (SELECT year, country, value, 'all net flows' AS scenario FROM report
            WHERE indicator_type = 'net_flow' AND flow_type = 'all'
        UNION ALL SELECT year, country, value, s.scenario FROM report,
            (VALUES ('scenario 1'), ('scenario 2'), ('scenario 3')) s(scenario)
            WHERE indicator_type = 'net_flow' AND flow_type = 'all' AND year = 2000
        UNION ALL SELECT year, country, net_flows, scenario FROM scenario_table) GROUP BY year, country""",
)


def _chart_6(value: str, share: str, gni: str, expression: str, extra: str) -> str:
    return f"""SELECT r.year, r.country, r.continent, r.income_level, r.prices, r.indicator_type,
        {expression} AS "{value}", {TITLED} AS flow_type, i.iso_code AS entity_code, b.gni AS "{gni}",
        {SHARE} AS "{share}"{extra}
    FROM report r LEFT JOIN isos i ON r.country = i.name
    LEFT JOIN balances b ON b.year = r.year AND b.entity_code = i.iso_code
    WHERE r.indicator_type = 'net_flow' AND r.year = 2000
        AND r.income_level IN ('Upper middle income', 'Lower middle income', 'Low income')"""


register(
    "chart_6",
    lambda t: charts.chart_6(_report(t), t.isos, t.gni, TRADE, unit=UNIT).transform(_round_share("value_pct_gni")),
    _chart_6("value", "value_pct_gni", "gni", ROUND_UNIT, ", CASE WHEN r.value < 0 THEN 'highlight' ELSE '' END AS color"),
)
register(
    "chart_6_download",
    lambda t: charts.chart_6(_report(t), t.isos, t.gni, TRADE, download=True).transform(_round_share(charts.NET_OF_GNI)),
    _chart_6(charts.NET_TITLE, charts.NET_OF_GNI, charts.GNI_TITLE, dbl("r.value"), ""),
)
