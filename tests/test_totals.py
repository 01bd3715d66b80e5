"""Null and edge semantics of sums, totals, pivots and orders."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fluxbook.operators import concessional, periods, reshape, totals

PREP = "year int, iso_code string, counterpart_area string, value double"


def test_prep_flows_nulls_zeros_world(frame, table_rows):
    df = frame([
        (2000, "A", "X", 1.0), (2000, "A", "X", 2.0), (2000, "A", None, 4.0), (2000, None, "X", 9.0),
        (2000, "A", "World", 9.0), (2000, "A", "Y", 0.0), (2000, "B", "X", None), (2000, "C", "X", math.nan),
    ], PREP)
    assert table_rows(totals.prep_flows(df)) == [
        (2000, "A", "X", 3.0), (2000, "A", None, 4.0), (2000, "B", "X", 0.0), (2000, "C", "X", 0.0),
    ]


def test_empty_input(frame, table_rows):
    assert table_rows(totals.prep_flows(frame([], PREP))) == []


FLOWS = "year int, country string, continent string, income_level string, prices string, indicator_type string, value double"
ROWS = [
    (2000, "A", "Africa", "Low income", "current", "inflow", 5.0),
    (2000, "A", "Africa", "Low income", "current", "outflow", -2.0),
    (2000, "B", "Asia", None, "current", "inflow", 7.0),
    (2000, "C", None, "High income", "current", "inflow", 1.0),
]


def test_net_flows_are_inflow_plus_outflow(frame, table_rows):
    net = totals.net_flows(frame(ROWS, FLOWS))
    assert table_rows(net, "country", "value", "indicator_type") == [("A", 3.0, "net_flow"), ("B", 7.0, "net_flow"), ("C", 1.0, "net_flow")]


def test_world_and_group_totals(frame, table_rows):
    df = frame(ROWS, FLOWS)
    world = totals.append_world_total(df).where("country = 'World'")
    assert table_rows(world, "indicator_type", "value", "continent") == [("inflow", 13.0, None), ("outflow", -2.0, None)]
    groups = totals.append_group_totals(df, "continent", ["income_level"])
    assert groups.count() == len(ROWS) + 3
    assert table_rows(groups.where("country = 'Asia'"), "value", "income_level") == [(7.0, None)]


def test_developing_total_equals_sum_of_countries(frame, table_rows):
    df = frame(ROWS, FLOWS)
    both = totals.with_developing_total(df, "Developing countries")
    total = both.where("country = 'Developing countries'")
    assert table_rows(total, "indicator_type", "value", "continent", "income_level") == [
        ("inflow", 13.0, "World", "All"), ("outflow", -2.0, "World", "All"),
    ]
    assert table_rows(total) == table_rows(totals.developing_total(df).select(*total.columns))
    assert both.count() == len(ROWS) + 2


def test_level_keeps_a_country_apart_from_a_total_of_its_name(frame, table_rows):
    df = frame([(2000, "Developing countries", "World", "All", "current", "inflow", 1.0)], FLOWS)
    assert [r[0] for r in table_rows(totals.with_developing_total(df, "Developing countries"), "value")] == [1.0, 1.0]


def test_group_summary_names_only_listed_groups(frame, table_rows):
    summary = totals.group_summary(frame(ROWS, FLOWS), ["Developing countries", "Africa", "Low income"])
    assert {r[0] for r in table_rows(summary, "country")} == {"Developing countries", "Africa", "Low income"}


def test_income_and_africa_rows(frame, table_rows):
    df = frame([(*r, "all") for r in ROWS], FLOWS + ", flow_type string")
    added = totals.append_income_levels(df).where("continent is null and country in ('Low income', 'High income')")
    assert table_rows(added, "country", "indicator_type", "value") == [("Low income", "inflow", 5.0), ("Low income", "outflow", -2.0)]
    africa = totals.append_africa(df).where("country = 'Africa'")
    assert table_rows(africa, "indicator_type", "value") == [("inflow", 5.0), ("outflow", -2.0)]


def test_dac_total_drops_null_keys(frame, table_rows):
    df = frame([(2000, 1, "a", "DAC", 1.0, 0.5), (2000, 2, "b", None, 2.0, None), (None, 3, "c", "x", 4.0, None)],
               "year int, donor_code int, donor_name string, iso_code string, value double, realistic_multiplier double")
    total = totals.append_dac_total(df).where("donor_code = 20001")
    assert table_rows(total) == [(2000, 20001, "DAC Countries", "DAC", 3.0)]


DEBT = "indicator string, year int, country string, counterpart_area string, value double"


def test_concessional_split(frame, table_rows):
    df = frame([
        ("T", 2000, "A", "X", 10.0), ("C", 2000, "A", "X", 4.0), ("T", 2000, "B", "X", 3.0),
        ("C", 2000, "Z", "X", 9.0), ("T", 2001, "A", None, None), ("C", 2001, "A", None, 1.0),
    ], DEBT)
    split = concessional.concessional_split(df, "T", "C", "bilateral")
    assert table_rows(split, "year", "country", "indicator", "value") == [
        (2000, "A", "bilateral_concessional", 4.0), (2000, "A", "bilateral_non_concessional", 6.0),
        (2000, "B", "bilateral_concessional", None), (2000, "B", "bilateral_non_concessional", 3.0),
        (2001, "A", "bilateral_concessional", 1.0), (2001, "A", "bilateral_non_concessional", -1.0),
    ]


def test_period_average_divides_by_fixed_length(frame, table_rows):
    df = frame([(2010, "A", 1.0), (2011, "A", 0.25), (2016, "A", 9.0)], "year int, country string, value double")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("continent", "income_level", "prices", "counterpart_type")})
    average = periods.average_by_period(df, {"2010-2014": (2010, 2014, 10)})
    assert table_rows(average, "period", "value") == [("2010-2014", 0.12)]  # 0.125, half to even


def test_pivot_is_unique_or_fails(frame, table_rows):
    df = frame([(2000, "a", 1.0), (2000, "b", 2.0), (2001, "a", 3.0)], "year int, kind string, value double")
    assert table_rows(reshape.pivot_unique(df, ["year"], "kind", ["a", "b"])) == [(2000, 1.0, 2.0), (2001, 3.0, None)]
    with pytest.raises(PySparkException, match="more than one row"):
        reshape.pivot_unique(df.union(df), ["year"], "kind", ["a", "b"]).collect()
    with pytest.raises(PySparkException, match="not listed"):
        reshape.pivot_unique(df, ["year"], "kind", ["a"]).collect()


def test_unpivot_keeps_nulls(frame, table_rows):
    df = frame([(1, 2.0, None)], "id int, a double, b double")
    assert table_rows(reshape.unpivot(df, ["id"], ["a", "b"])) == [(1, "a", 2.0), (1, "b", None)]


def test_custom_sort(frame):
    df = frame([("x", 2), ("Low", 1), ("a", 1), ("Top", 1), ("x", 1)], "country string, year int")
    ordered = [tuple(r) for r in reshape.custom_sort(df, "country", ["Top", "Low"], "year").collect()]
    assert ordered == [("Top", 1), ("Low", 1), ("a", 1), ("x", 1), ("x", 2)]


def test_order_countries(frame):
    df = frame([("Z", 1, "Private"), ("Africa", 1, "Private"), ("Africa", 1, "Bilateral"), ("Africa", 0, "x")],
               "country string, year int, counterpart_type string")
    ordered = [tuple(r) for r in reshape.order_countries(df, {"Africa": 7}, True).collect()]
    assert ordered == [("Africa", 0, "x"), ("Africa", 1, "Bilateral"), ("Africa", 1, "Private"), ("Z", 1, "Private")]
