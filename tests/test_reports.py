"""Reports on a small flow table with the published settings."""

import os

from pyspark.sql import functions as F

from fluxbook import FlowSettings
from fluxbook.plans import charts, reports, scenario_reports as sr
from fluxbook.plans.flows import flows_by_version
from fluxbook.sources import scans, schemas, sinks

SETTINGS = FlowSettings()


def flow_table(spark):
    rows = [
        (2023, "Kenya", "Africa", "Lower middle income", "France", "Bilateral", "bilateral_concessional", "inflow", "current", 10.0),
        (2023, "Kenya", "Africa", "Lower middle income", "China", "Bilateral", "bilateral_non_concessional", "inflow", "current", 20.0),
        (2023, "Kenya", "Africa", "Lower middle income", "France", "Bilateral", "bilateral_non_concessional", "outflow", "current", -5.0),
        (2023, "Chad", "Africa", "Low income", "France", "Bilateral", "grants_bilateral", "inflow", "current", 7.0),
        (2023, "Chad", "Africa", "Low income", "France", "Bilateral", "bilateral_concessional", "outflow", "current", -1.0),
        (2023, "Peru", "America", None, "Bank", "Private", "bonds", "inflow", "current", 4.0),
        (2023, "China", "Asia", "Upper middle income", "Bank", "Private", "bonds", "outflow", "current", -9.0),
        (2024, "Kenya", "Africa", "Lower middle income", "France", "Bilateral", "bilateral_concessional", "outflow", "current", -6.0),
        (2030, "Kenya", "Africa", "Lower middle income", "France", "Bilateral", "bilateral_concessional", "outflow", "current", -99.0),
    ]
    return spark.createDataFrame(rows, schemas.FLOWS)


def test_version_filter_precedes_outflow_rule(spark, table_rows):
    flows = flow_table(spark)
    total = flows_by_version(flows, SETTINGS)
    market = flows_by_version(flows, SETTINGS, version="excluding_concessional_finance")
    countries = lambda df: {r[0] for r in table_rows(df, "country")}
    assert countries(total) == {"Kenya", "Chad"}  # Peru has no outflow, China is an outlier
    assert countries(market) == {"Kenya"}  # Chad's only outflow is concessional


def test_debt_service_filters_version_after_outflow_rule(spark, table_rows):
    paid = reports.debt_service_report(flow_table(spark), SETTINGS, "total")
    assert table_rows(paid.where("country = 'Developing countries'"), "year", "value") == [(2023, 6.0), (2024, 6.0)]
    market = reports.debt_service_report(flow_table(spark), SETTINGS, "excluding_concessional_finance")
    assert table_rows(market, "country", "value") == [("Developing countries", 5.0), ("Kenya", 5.0)]


def test_net_flow_report_rows(spark, table_rows):
    report = reports.net_flows_report(flow_table(spark), SETTINGS)
    net = report.where("indicator_type = 'net_flow' and flow_type = 'all'")
    assert table_rows(net, "country", "value") == [
        ("Africa", 31.0), ("Chad", 6.0), ("Developing countries", 31.0), ("Kenya", 25.0),
        ("Low income", 6.0), ("Lower middle income", 25.0),
    ]
    inflow, outflow, both = (
        {r.country: r.value for r in report.where(f"indicator_type = '{t}' and flow_type = 'all'").collect()}
        for t in ("inflow", "outflow", "net_flow")
    )
    assert all(both[c] == inflow[c] + outflow[c] for c in both)


def test_historical_inflows_drop_null_labels(spark, table_rows):
    inflows = reports.historical_inflows(
        flow_table(spark), SETTINGS, china_as_counterpart_type=True, remove_countries_wo_outflows=False
    )
    assert "Peru" not in {r[0] for r in table_rows(inflows, "country")}
    total = inflows.where("country = 'Developing countries'")
    assert table_rows(total, "counterpart_type", "value") == [
        ("Bilateral (excl. China)", 17.0), ("China", 20.0), ("Private (excl. China)", 4.0),
    ]


def test_projected_outflows_and_scenarios(spark, frame, table_rows):
    flows = flow_table(spark)
    estimates = reports.projected_outflows(flows, SETTINGS)
    assert table_rows(estimates.where("country = 'Kenya'"), "year", "value") == [(2024, -6.0), (2030, -99.0)]
    latest = sr.latest_inflows(flows, SETTINGS)
    assert {r[0] for r in table_rows(latest, "year")} == {2023}
    isos = frame([("France", "FRA"), ("China", "CHN")], "name string, iso_code string")
    factors = frame([(2025, "FRA", "France", 0.5)], "year int, iso_code string, donor string, realistic_multiplier double")
    inflows = sr.inflow_scenarios(latest, isos, factors, SETTINGS)
    kenya = {(r.scenario, r.year): r.value for r in inflows.where("country = 'Kenya'").collect()}
    assert kenya["scenario 1", 2027] == 30.0 and kenya["scenario 2", 2025] == 25.0 and kenya["scenario 2", 2026] == 30.0
    table = sr.net_flow_scenarios(inflows, estimates, SETTINGS)
    kenya = {(r.scenario, r.year): r.net_flows for r in table.where("country = 'Kenya'").collect()}
    assert kenya["scenario 1", 2024] == 24.0 and kenya["scenario 1", 2025] is None
    africa = {(r.scenario, r.year): r.outflows for r in table.where("country = 'Africa'").collect()}
    assert africa["scenario 1", 2025] == 0.0


def test_chart_6_percent_and_rounding(spark, frame):
    rows = [
        (2023, "A", "Asia", "Low income", "current", "net_flow", 3103522391.0, "all"),
        (2023, "B", "Asia", "Upper middle income", "current", "net_flow", -1234.0, "excluding_concessional"),
        (2022, "A", "Asia", "Low income", "current", "net_flow", 1.0, "all"),
    ]
    net = spark.createDataFrame(rows, schemas.NET_FLOWS)
    isos = frame([("A", "AAA"), ("B", "BBB")], "name string, iso_code string")
    gni = frame([(2023, "AAA", 15613673958.5595)], "year int, entity_code string, gni double")
    out = charts.chart_6(net, isos, gni, SETTINGS).collect()
    assert [(r.country, r.value, r.color, r.flow_type) for r in out] == [
        ("B", 0.0, "highlight", "excluding concessional finance"), ("A", 3.1, "", "all flows"),
    ]
    assert out[0].value_pct_gni is None and out[1].value_pct_gni == 3103522391.0 / 15613673958.5595 * 100


def test_sinks_use_the_shared_folder(spark, capsys):
    path = sinks.shared_folder(spark, "table")
    assert os.path.dirname(path) == spark.conf.get("spark.checkpoint.dir")
    assert path != sinks.shared_folder(spark, "table")
    debt = spark.sql("select timestamp'2000-01-01' year, 'A' country, 'B' counterpart_area, 1.0D value, 'X.1' indicator")
    sinks.land_debt(debt, path)
    landed = scans.scan_debt(scans.read_table(spark, path), ["X.1"], 2000, 2000)
    landed.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(indicator" in plan
    assert "GreaterThanOrEqual(year,2000-01-01" in plan
    assert landed.count() == 1


def test_one_csv_file_for_charts(spark):
    path = sinks.shared_folder(spark, "chart")
    sinks.write_csv(spark.range(5).withColumn("name", F.lit("x")), path, single_file=True)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 1
