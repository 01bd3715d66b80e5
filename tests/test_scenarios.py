"""Scenario operators: identities, factors, classes and validation."""

import pytest
from pyspark.sql import functions as F

from fluxbook.operators import scenarios as sc

FLOWS = "year int, iso_code string, indicator string, value double"
ROWS = [
    (2022, "FRA", "grants_bilateral", 1.0), (2023, "FRA", "grants_bilateral", 100.0),
    (2023, "USA", "grants_bilateral", 200.0), (2023, "KEN", "bilateral_concessional", 50.0),
    (2023, "KEN", "bonds", 10.0), (2023, None, "grants_bilateral", 30.0),
]


def test_no_cut_repeats_the_latest_year(frame, table_rows):
    df = frame(ROWS, FLOWS)
    ahead = sc.project_linear(df, "concessional_finance", 0, 2025)
    assert ahead.count() == len(ROWS) + 2 * 5
    assert table_rows(ahead.where("year = 2025").drop("year")) == table_rows(df.where("year = 2023").drop("year"))


def test_linear_cut_applies_to_reducible_future_rows(frame, table_rows):
    ahead = sc.project_linear(frame(ROWS, FLOWS), "grants", 60, 2027).where("iso_code in ('USA', 'KEN')")
    usa = [r.value for r in ahead.where("iso_code = 'USA'").orderBy("year").collect()]
    assert usa == pytest.approx([200.0, 170.0, 140.0, 110.0, 80.0])
    assert {r[0] for r in table_rows(ahead.where("iso_code = 'KEN'"), "value")} == {10.0, 50.0}


def test_target_before_latest_adds_nothing(frame):
    assert sc.project_linear(frame(ROWS, FLOWS), None, 50, 2020).count() == len(ROWS)


def test_multiplier_applies_to_every_year_and_defaults_to_one(frame, table_rows):
    factors = frame([(2023, "FRA", 0.5), (2025, "FRA", 0.1)], "year int, iso_code string, realistic_multiplier double")
    out = sc.project_with_multiplier(frame(ROWS, FLOWS), factors, "grants", target_year=2025)
    assert table_rows(out.where("iso_code = 'FRA'"), "year", "value") == [(2022, 1.0), (2023, 50.0), (2024, 100.0), (2025, 10.0)]


FACTORS = "year int, iso_code string, donor string, realistic_multiplier double"


def test_scenarios_equal_the_separate_branches(frame, table_rows):
    df = frame(ROWS, FLOWS)
    factors = frame([(2023, "FRA", "France", 1.0), (2025, "FRA", "France", 0.5)], FACTORS)
    ramp = sc.Ramp(0.2, 2024, 2025)
    spec = sc.Scenario("scenario 3", donors=True, usa=80, rest=10, ramp=ramp)
    both = sc.project_scenarios(df, factors, [sc.SCENARIO_1, spec], "grants", 2025)
    one = both.where("scenario = 'scenario 1'").drop("scenario")
    assert table_rows(one) == table_rows(sc.project_linear(df, "grants", 0, 2025))
    three = both.where("scenario = 'scenario 3'").drop("scenario")
    reduced = sc.ramp_multiplier(factors, 0.2, 2024, 2025)
    parts = (
        sc.project_with_multiplier(df.where("iso_code = 'FRA'"), reduced, "grants", "realistic_multiplier_reduced", 2025).drop("realistic_multiplier_reduced")
        .union(sc.project_linear(df.where("iso_code = 'USA'"), "grants", 80, 2025))
        .union(sc.project_linear(df.where("iso_code is null or iso_code = 'KEN'"), "grants", 10, 2025))
    )
    key = lambda d: [tuple(r) for r in d.withColumn("value", F.round("value", 9)).orderBy("year", "iso_code", "indicator").collect()]
    assert key(three) == key(parts)


def test_each_class_extends_its_own_latest_year(frame, table_rows):
    df = frame([(2020, "USA", "x", 1.0), (2021, "FRA", "x", 2.0), (2023, "KEN", "x", 3.0)], FLOWS)
    factors = frame([(2021, "FRA", "France", 1.0)], FACTORS)
    out = sc.project_scenarios(df, factors, [sc.SCENARIO_2], None, 2024)
    assert [r[0] for r in table_rows(out.where("iso_code = 'USA'"), "year")] == [2020, 2021, 2022, 2023, 2024]
    assert [r[0] for r in table_rows(out.where("iso_code = 'KEN'"), "year")] == [2023, 2024]


def test_duplicate_multipliers_do_not_touch_history(frame):
    df = frame([(2023, "FRA", "x", 2.0)], FLOWS)
    factors = frame([(2023, "FRA", "a", 1.0), (2023, "FRA", "b", 1.0)], FACTORS)
    history = sc.Scenario("history", extend=False)
    out = sc.project_scenarios(df, factors, [history, sc.SCENARIO_2], None, 2023)
    assert out.where("scenario = 'history'").count() == 1
    assert out.where("scenario = 'scenario 2'").count() == 2


def test_ramp_and_validation(frame, table_rows):
    df = frame([(y, "FRA", "France", 1.0) for y in (2024, 2025, 2026, 2027, 2030)], FACTORS)
    reduced = table_rows(sc.ramp_multiplier(df, 0.3, 2025, 2027), "realistic_multiplier_reduced")
    assert [r[0] for r in reduced] == pytest.approx([0.7, 0.7, 0.8, 0.9, 1.0])
    with pytest.raises(ValueError):
        sc.ramp_multiplier(df, 0.1, 2027, 2025)


def test_multipliers_over_the_own_base_year(frame, table_rows):
    wide = frame([(2023, "FRA", "France", 10.0), (2025, "FRA", "France", 6.0), (2025, "KEN", "Kenya", 1.0)],
                 "year int, iso_code string, donor string, realistic double")
    deflators = frame([(2023, "FRA", 100.0), (2025, "FRA", 50.0)], "year int, iso_code string, usd_usd_deflator double")
    assert table_rows(sc.multipliers(wide, deflators)) == [(2023, "FRA", "France", 1.0), (2025, "FRA", "France", 0.3)]


@pytest.mark.parametrize("raw, clean", [
    ("ODA Realistic (USD bn)", "oda_realistic"), ("Health BL Upside", "health_bilateral_upside"),
    ("WB ML_Value", "wb_multilateral"), ("AG BL Realistic", "agriculture_bilateral_realistic"), ("_Year_", "year"),
])
def test_clean_column_name(raw, clean):
    assert sc.clean_column_name(raw) == clean


def test_families(frame):
    wide = frame([(2023, "F", 1.0, 2.0, 3.0)], "year int, donor string, scholarship double, idrc double, idrc_downside double")
    assert sc.select_family(wide, "scholarship").columns == ["year", "donor", "realistic"]
    assert sc.select_family(wide, "idrc").columns == ["year", "donor", "realistic", "downside"]


def test_extend_year(frame, table_rows):
    out = sc.extend_year(frame([(2022, 1.0), (2023, 2.0)], "year int, value double"))
    assert table_rows(out) == [(2022, 1.0), (2023, 2.0), (2024, 2.0)]
