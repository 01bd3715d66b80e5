"""Joins on keys that are often NULL, and lookups that must be unique."""

import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from checks import registry
from checks.relations import TRADE, trade
from fluxbook.operators import joins, scenarios as sc
from fluxbook.operators.series import Currencies, currency_deflators, currency_rates, deflate, deflate_between
from fluxbook.plans import scenario_reports as sr


@pytest.fixture
def shuffled(spark):
    """No broadcasts and no merging of partitions, as with tables that are large."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_spread_join_is_the_plain_join(shuffled, frame, null_safe, how):
    left = frame([(k, y, v) for v, (k, y) in enumerate([("a", 1), ("a", None), (None, 1), (None, None), ("b", 1), ("b", 1), (None, 1)])], "k string, y int, v int")
    right = frame([("a", 1, 10), (None, 1, 20), (None, None, 30), ("c", 1, 40), ("b", 1, 50), ("b", 1, 60)], "k string, y int, w int")
    found = joins.spread_join(left, right, ["k", "y"], how, null_safe)
    same = (F.col("l.k").eqNullSafe(F.col("r.k")) & F.col("l.y").eqNullSafe(F.col("r.y"))) if null_safe else (F.col("l.k") == F.col("r.k")) & (F.col("l.y") == F.col("r.y"))
    plain = left.alias("l").join(right.alias("r"), same, how)
    columns = ["l.k", "l.y", "l.v"] + (["r.w"] if how in ("left", "inner") else [])
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, plain.select(*columns).collect()), key=str)
    with pytest.raises(ValueError):
        joins.spread_join(left, right, ["k"], "full_outer")


@pytest.mark.parametrize("null_safe", [False, True])
def test_rows_without_a_key_spread(shuffled, null_safe):
    """A third of the keys NULL: no task of the join has more than twice the rows of the median one."""
    rows = shuffled.range(120_000).select(F.when(F.col("id") % 3 != 0, F.concat(F.lit("k"), F.col("id") % 5000)).alias("k"), "id")
    lookup = shuffled.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    if null_safe:
        lookup = lookup.unionByName(shuffled.sql("SELECT CAST(NULL AS STRING) AS k, 7L AS v"))
    joined = joins.spread_join(rows, lookup, ["k"], null_safe=null_safe)
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 120_000 and max(sizes) <= 2 * statistics.median(sizes)
    plain = rows.join(lookup, rows["k"] == lookup["k"], "left").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in plain) > 40_000


def test_lookups_must_be_unique(frame, table_rows):
    df = frame([("FRA", 1), ("ITA", 2), (None, 3)], "iso_code string, v int")
    levels = frame([("FRA", "High"), ("KEN", "Low"), (None, "x"), (None, "y")], "iso_code string, income_level string")
    assert table_rows(joins.add_income_level(df, levels), "iso_code", "v", "income_level") == [("FRA", 1, "High"), ("ITA", 2, None), (None, 3, None)]
    twice = levels.unionByName(frame([("FRA", "Low")], "iso_code string, income_level string"))
    with pytest.raises(PySparkException, match="more than one row for iso_code = FRA"):
        joins.add_income_level(df, twice).collect()
    projections = frame([(2023, "FRA", "France", 2.0)], "year int, iso_code string, donor string, realistic double")
    deflators = frame([(2023, "FRA", 100.0), (2023, "FRA", 90.0)], "year int, iso_code string, usd_usd_deflator double")
    with pytest.raises(PySparkException, match="more than one row"):
        sc.multipliers(projections, deflators).collect()


RATES = "iso_code string, year int, rate double"
DEFLATORS = "iso_code string, year int, deflator double"


@pytest.fixture
def rates(frame):
    deflators = frame([("A", 2000, 100.0), ("A", 2001, 125.0), ("B", 2000, 100.0), ("B", 2001, 200.0), ("C", 2001, 50.0)], DEFLATORS)
    exchange = frame([("A", 2000, 2.0), ("A", 2001, 1.0), ("B", 2000, 0.5), ("B", 2001, 0.25)], RATES)
    return currency_rates(deflators, exchange, 2000)


@pytest.mark.parametrize("source, target, wanted", [
    ("LCU", "LCU", 100 / 1.25),
    ("LCU", "USD", 100 / 1.25 * 2.0),
    ("USD", "LCU", 100 / 1.0 / 1.25),
    ("USD", "USD", 100 / 1.0 / 1.25 * 2.0),
    ("B", "USD", 100 * 0.25 / 1.0 / 1.25 * 2.0),
    ("LCU", "B", 100 / 1.25 * 2.0 / 0.5),
])
def test_currencies_there_and_back(frame, rates, source, target, wanted):
    flows = frame([("A", 2001, 100.0)], "iso_code string, year int, value double")
    there = deflate_between(flows, rates, [Currencies(source, target)])
    assert [r["value"] for r in there.collect()] == pytest.approx([wanted])
    back = deflate_between(there.select("iso_code", "year", "value"), rates, [Currencies(source, target, True)])
    assert [(r["value"], r["source_currency"], r["to_current"]) for r in back.collect()] == [(pytest.approx(100.0), source, True)]
    table = currency_deflators(rates, Currencies(source, target))
    assert [r["value"] for r in deflate(flows, table).collect()] == pytest.approx([wanted])


def test_missing_rates_give_null(frame, rates, table_rows):
    flows = frame([("C", 2001, 1.0), ("A", 1999, 1.0), (None, 2001, 1.0), ("A", 2000, 1.0), ("A", 2001, None)], "iso_code string, year int, value double")
    found = table_rows(deflate_between(flows, rates, [Currencies("LCU", "USD")]), "iso_code", "year", "value")
    assert found == [("A", 1999, None), ("A", 2000, 2.0), ("A", 2001, None), ("C", 2001, None), (None, 2001, None)]
    assert deflate_between(flows.limit(0), rates, [Currencies()]).collect() == []


@pytest.mark.parametrize("build", [
    lambda t: registry._inflow_scenarios(t),
    lambda t: sr.aid_scenarios(t.aid, t.isos, registry._factors(t), TRADE, (sc.SCENARIO_2, registry.SCENARIO_3)),
])
def test_factors_are_read_once(spark, build):
    """Each donor's multipliers come in one row: the final plan makes those rows once (partial and final sum), from
    one scan for the projections and one for their deflators, beside the one of the facts."""
    df = build(trade(spark, "/root/testdata/sf0.001"))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    assert sum("collect_list" in line for line in final) == 2
    assert sum("FileScan" in line and "o_orderdate" in line for line in final) == 3
