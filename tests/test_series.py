"""Series operators against hand-computed values."""

import pytest

from fluxbook.operators import series

SERIES = "iso_code string, year int, value double"


def close(actual, expected):
    assert len(actual) == len(expected)
    for a, e in zip(actual, expected):
        assert a == (pytest.approx(e) if e is not None else None)


def by_year(df, iso):
    return [r.value for r in df.where(f"iso_code = '{iso}'").orderBy("year").collect()]


def test_growth_pads_gaps_and_drops_undefined(frame):
    df = frame([("A", 2000, 10.0), ("A", 2001, None), ("A", 2002, 15.0), ("B", 2000, 0.0), ("B", 2001, 5.0), ("C", 2000, None), ("C", 2001, 2.0), ("C", 2002, 3.0)], SERIES)
    growth = series.growth_rate(df)
    close(by_year(growth, "A"), [0.0, 0.5])
    assert by_year(growth, "B") == []
    close(by_year(growth, "C"), [0.5])


def test_index_equals_value_over_base(frame):
    df = frame([("A", 2000, 10.0), ("A", 2001, 20.0), ("A", 2002, 30.0), ("B", 2000, 5.0), ("B", 2002, 6.0)], SERIES)
    index = series.growth_index(df, 2001)
    close(by_year(index, "A"), [1.0, 1.5])
    assert by_year(index, "B") == [None]  # no base year


def test_exchange_deflator_needs_base_year(frame, table_rows):
    local = frame([("A", 2000, 2.0), ("A", 2001, 4.0), ("B", 2001, 1.0)], SERIES)
    dollars = frame([("A", 2000, 1.0), ("A", 2001, 1.0), ("B", 2001, 1.0)], SERIES)
    assert table_rows(series.exchange_deflator(local, dollars, 2000)) == [(2000, "A", 100.0), (2001, "A", 50.0)]


EXTEND = [
    *[("A", 2000 + i, float(v)) for i, v in enumerate((10, 12, 15, 19, 24))],
    *[("B", 2001 + i, float(v)) for i, v in enumerate((12, 15, 19, 24))],
    ("C", 2003, 1.0), ("C", 2004, 2.0),
]


def test_extend_series_published_and_clean(frame):
    df = frame(EXTEND, SERIES)
    published = series.extend_series(df, 2006)
    close(by_year(published, "A"), [10, 12, 15, 19, 24, 31, 35])
    close(by_year(published, "B"), [12, 15, 19, 24, 28, 32])
    close(by_year(published, "C"), [1, 2, None, None])
    close(by_year(series.extend_series(df, 2006, mode="clean"), "A"), [10, 12, 15, 19, 24, 28, 32])
    with pytest.raises(ValueError):
        series.extend_series(df, 2006, mode="other")


def test_extend_series_falls_back_to_the_previous_mean(frame):
    rows = [("A", 2000 + i, v) for i, v in enumerate((10.0, 12.0, 15.0, 19.0, None))]
    # m(2004) is undefined, so m(2003) = 3 serves every step, starting from 19.
    close(by_year(series.extend_series(frame(rows, SERIES), 2006), "A"), [10, 12, 15, 19, None, 25, 28])


def test_extend_series_does_not_count_down(frame):
    df = frame(EXTEND, SERIES)
    assert series.extend_series(df, 1990).count() == len(EXTEND)


def test_future_gni_uses_the_global_last_year(frame, table_rows):
    gni = frame([("A", 2000, 10.0), ("A", 2001, 20.0), ("B", 2000, 5.0)], SERIES)
    index = frame([("A", 2001, 1.0), ("A", 2002, 1.1), ("B", 2002, 2.0)], SERIES)
    future = series.future_gni(gni, index, "current")
    assert table_rows(future) == [(2002, "A", pytest.approx(22.0))]


def test_grid(frame, table_rows):
    isos = frame([("A",), ("A",), ("B",)], "iso_code string")
    assert table_rows(series.year_iso_grid(isos, 2000, 2001)) == [(2000, "A"), (2000, "B"), (2001, "A"), (2001, "B")]
    assert table_rows(series.year_iso_grid(isos, 2001, 2000)) == []


def test_deflate_there_and_back(frame, table_rows):
    df = frame([("A", 2000, 50.0), ("A", 2001, 60.0), ("B", 2000, 1.0)], SERIES)
    deflators = frame([("A", 2000, 50.0), ("A", 2001, 0.0)], "iso_code string, year int, deflator double")
    constant = series.deflate(df, deflators)
    assert table_rows(constant) == [("A", 2000, 100.0), ("A", 2001, None), ("B", 2000, None)]
    assert table_rows(series.deflate(constant, deflators, to_current=True).where("year = 2000 and iso_code = 'A'")) == [("A", 2000, 50.0)]
