"""Debt and aid in one table: the router, the flows in it, and their plans."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from checks.relations import TRADE, trade
from fluxbook.operators import landing
from fluxbook.plans import flows as fl

FOLDER = "/root/testdata/sf0.001"


def final_plan(df):
    """The plan after all of its stages have run."""
    df.write.format("noop").mode("overwrite").save()
    execution = df._jdf.queryExecution()
    df.collect()
    return execution.executedPlan().toString()


def test_route_repeats_a_fact_for_every_use(frame, table_rows):
    facts = frame([("O", 1, 2.0, 3.0, "x"), ("F", 2, 5.0, None, "y"), ("Z", 9, 1.0, 1.0, "z")], "status string, line int, principal double, interest double, who string")
    routes = frame(
        [("O", 1, "debt", "A", "current", "principal", 1.0), ("O", 1, "aid", "G", "constant", "principal", 2.0), ("O", 1, "debt", "B", "current", "interest", 1.0),
         ("F", 2, "debt", "C", "current", "interest", 1.0)],
        "status string, line int, source string, indicator string, prices string, measure string, times double",
    )
    routed = landing.route(facts, routes, ["status", "line"], ["principal", "interest"])
    assert table_rows(routed, "who", "source", "indicator", "value") == [
        ("x", "aid", "G", 4.0), ("x", "debt", "A", 2.0), ("x", "debt", "B", 3.0), ("y", "debt", "C", None),
    ]


def test_two_tables_give_the_same_flows(spark, table_rows):
    """Separate debt and aid tables, laid together, and a table that comes routed."""
    t = trade(spark, FOLDER)
    apart = dataclasses.replace(t.sources, landed=None)
    for constant in (False, True):
        for build in (fl.all_flows, fl.total_inflows):
            one, other = (build(src, TRADE, constant) for src in (t.sources, apart))
            money = F.col("value").cast("decimal(38,4)").alias("value")
            one, other = (df.select(*sorted(set(df.columns) - {"value"}), money) for df in (one, other))
            assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty() and not one.isEmpty()


def test_inflows_are_grants_and_debt(spark, table_rows):
    """The one pass gives what the two sources give one by one."""
    t = trade(spark, FOLDER)
    columns = ["year", "iso_code", "country", "continent", "counterpart_area", "counterpart_iso_code", "income_level", "indicator", "counterpart_type", "prices"]
    money = F.col("value").cast("decimal(38,4)").alias("value")
    apart = fl.grants_inflows(t.sources, TRADE).select(*columns, money).unionByName(fl.debt_inflows(t.sources, TRADE).select(*columns, money))
    both = fl.total_inflows(t.sources, TRADE).select(*columns, money)
    assert both.exceptAll(apart).isEmpty() and apart.exceptAll(both).isEmpty()


def test_edges_of_landed_rows(spark, frame, table_rows):
    """Empty tables, unlisted codes, years outside, NULL keys and values, donors without a name."""
    t = trade(spark, FOLDER)
    debt = frame(
        [("DT.DIS.BLAT.CD", "1996", "NATION_1", " NATION_2 ", 5.0), ("DT.DIS.BLAT.CD", "1996", None, None, 5.0), ("DT.DIS.BLAT.CD", "1996", "NATION_1", "NATION_2", float("nan")),
         ("DT.DIS.BLTC.CD", "1996", "NATION_1", " NATION_2 ", 2.0), ("DT.DIS.BLTC.CD", "1997", "NATION_1", "NATION_2", 2.0), ("??", "1996", "NATION_1", "NATION_2", 9.0),
         ("DT.DIS.PBND.CD", "1900", "NATION_1", "NATION_2", 9.0), ("DT.DIS.PBND.CD", "1996", "NATION_1", "NATION_2", 0.0), ("DT.AMT.PBND.CD", "2004", "NATION_1", "NATION_2", 4.0)],
        "indicator string, y string, country string, counterpart_area string, value double",
    ).select("indicator", F.to_timestamp_ntz(F.concat("y", F.lit("-01-01")), F.lit("yyyy-MM-dd")).alias("year"), "country", "counterpart_area", "value")
    aid = frame(
        [(1996, 2, 1, "current", "g", 1.0), (1996, None, 1, "current", "g", 1.0), (1996, 2, None, "current", "g", 1.0), (1996, 2, 1, "constant", "g", 7.0),
         (2002, 2, 1, "current", "g", 1.0), (1996, 2, 1, None, "g", 1.0), (1996, 22, 1, "current", "g", 1.0), (1996, 1038, 1, "current", "g", 1.0)],
        "year int, donor_code int, recipient_code int, prices string, indicator string, value double",
    )
    src = dataclasses.replace(t.sources, landed=None, debt=debt, aid=aid)
    found = [(r.year, r.country, r.counterpart_area, r.indicator, r.indicator_type, r.value) for r in fl.flow_rows(src, TRADE).collect()]
    assert sorted(found, key=str) == sorted([
        (1996, "Country 1", "NATION_2", "bilateral_concessional", "inflow", 2.0), (1996, "Country 1", "NATION_2", "bilateral_non_concessional", "inflow", 3.0),
        (1996, None, None, "bilateral_non_concessional", "inflow", 5.0), (2004, "Country 1", "NATION_2", "bonds", "outflow", 4.0),
        (1996, "Country 1", "NATION_2", "grants_bilateral", "inflow", 1e6),
    ], key=str)
    none = dataclasses.replace(src, debt=debt.limit(0), aid=aid.limit(0))
    assert fl.all_flows(none, TRADE).collect() == []
    with pytest.raises(ValueError, match="deflator"):
        fl.all_flows(dataclasses.replace(src, deflators=None), TRADE, constant=True)


@pytest.mark.parametrize("build", [fl.all_flows, fl.total_inflows])
def test_facts_are_read_once(spark, build):
    plan = build(trade(spark, FOLDER).sources, TRADE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_extendedprice") and sum("FileScan" in line and "l_extendedprice" in line for line in plan.splitlines()) == 1
