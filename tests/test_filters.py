"""Null and edge semantics of filters, masks and joins."""

import pytest
from pyspark.sql import functions as F

from fluxbook.functions import masks
from fluxbook.operators import filters, joins
from fluxbook.operators.names import NameBook, NamePattern, alias_table, clean_creditors, clean_debtors, creditor_aliases, debtor_aliases


def test_masks(frame, table_rows):
    names = ["grants_bilateral", "Official GRANT", "bilateral_concessional", "non-concessional", "Nonconcessional loan", "bonds", None]
    df = frame([(n,) for n in names], "indicator string")
    kept = [r[0] for r in table_rows(filters.exclude_grants_and_concessional(df))]
    assert kept == ["Nonconcessional loan", "bonds", "non-concessional"]
    assert len(table_rows(filters.exclude_grants(df))) == 4


def test_unknown_versions_raise():
    with pytest.raises(ValueError):
        masks.version_mask("everything")
    with pytest.raises(ValueError):
        masks.reducible("bonds")


def test_null_country_survives_outlier_filter(frame, table_rows):
    df = frame([("China",), ("Chad",), (None,)], "country string")
    assert table_rows(filters.exclude_outlier_countries(df, ["China"])) == [("Chad",), (None,)]


def test_null_name_drops_with_totals(frame, table_rows):
    df = frame([("DAC, Total",), ("France",), (None,)], "counterpart_area string")
    assert table_rows(filters.drop_counterpart_totals(df)) == [("France",)]


@pytest.mark.parametrize("as_table", [False, True])
def test_official_donors_and_grant_labels(frame, table_rows, as_table):
    df = frame([(1,), (2,), (1046,), (7,), (None,)], "donor_code int")
    group = frame([(1,), (2,), (2,)], "code int") if as_table else {1: "a", 2: "b"}
    assert table_rows(filters.keep_official_donors(df, group)) == [(1,), (2,), (1046,)]
    labels = dict(table_rows(filters.assign_grants_indicator(df, group)))
    assert labels[2] == "grants_bilateral" and labels[7] == labels[None] == "grants_multilateral"


def test_assign_indicator_takes_columns_present(frame):
    df = frame([(2000, "Chad", 1.0, "x")], "year int, country string, value double, note string")
    assert filters.assign_indicator(df, "bonds").columns == ["year", "country", "value", "indicator"]


FLOWS = "year int, country string, indicator_type string, value double"


def test_outflow_rule_both_forms(frame, table_rows):
    df = frame([
        (2000, "A", "inflow", 1.0), (2000, "A", "outflow", -1.0), (2001, "A", "inflow", 1.0),
        (2000, "B", "inflow", 2.0), (2000, None, "inflow", 3.0), (2000, None, "outflow", -3.0),
        (None, "C", "inflow", 1.0), (None, "C", "outflow", 1.0), (2000, "D", "outflow", None),
    ], FLOWS)
    window = table_rows(filters.keep_countries_with_outflows(df))
    assert window == table_rows(filters.semi_join_outflows(df))
    assert {(y, c) for y, c, _, _ in window} == {(2000, "A"), (2000, None), (2000, "D")}


def test_split_counterpart_keeps_nulls(frame, table_rows):
    df = frame([("China", "Bilateral"), ("France", "Bilateral"), (None, "Private")], "counterpart_area string, counterpart_type string")
    assert table_rows(filters.split_counterpart(df)) == [("China", "China"), ("France", "Bilateral"), (None, "Private")]


def test_flag_comes_from_the_unrounded_value(frame):
    df = frame([(-0.001,), (0.0,), (None,)], "value double").transform(filters.flag_negative)
    assert [r.color for r in df.withColumn("value", F.bround("value", 2)).collect()] == ["highlight", "", ""]


def test_natural_join_matches_null_keys(frame, table_rows):
    left = frame([(2000, None, 1.0), (2001, "x", 2.0)], "year int, income_level string, inflows double")
    right = frame([(2000, None, 9.0)], "year int, income_level string, outflows double")
    assert table_rows(joins.natural_left_join(left, right), "year", "outflows") == [(2000, 9.0), (2001, None)]


def test_names_alias_first_then_first_pattern(spark, frame, table_rows):
    aliases = alias_table(spark, [("Ivory Coast", "CIV", "Cote d'Ivoire", "Africa"), ("GDR", None, "Germany", None)])
    book = NameBook(aliases, (
        NamePattern("(?i)^niger$", "NER", "Niger", "Africa"),
        NamePattern("(?i)niger", "NGA", "Nigeria", "Africa"),
        NamePattern("(?i)gdr|ivory", "ZZZ", "Wrong", "Nowhere"),
    ))
    df = frame([("NIGER",), ("Nigeria, Fed.",), ("Ivory Coast",), ("Atlantis",), (None,)], "country string")
    assert table_rows(clean_debtors(df, "country", book), "iso_code", "country", "continent") == [
        ("CIV", "Cote d'Ivoire", "Africa"), ("NER", "Niger", "Africa"), ("NGA", "Nigeria", "Africa"),
        (None, "Atlantis", "Atlantis"), (None, None, None),
    ]
    creditors = clean_creditors(frame([("GDR",), ("Bank X",)], "counterpart_area string"), "counterpart_area", book)
    assert table_rows(creditors) == [("Bank X", "Bank X"), ("Germany", "ZZZ")]


def test_fixed_alias_tables(spark, table_rows):
    creditors = creditor_aliases(spark)
    assert creditors.count() == creditors.select("alias").distinct().count() == 145 + 7
    found = {r.alias: (r.iso_code, r.name) for r in creditors.collect()}
    assert found["World Bank-IDA"] == ("WB International Development Association",) * 2
    assert found["Yugoslavia"] == ("YUG", None) and found["GermanDem.Rep."] == (None, "Germany")
    assert table_rows(debtor_aliases(spark)) == [("Macau (China)", "MAC", "Macau", "Asia")]
