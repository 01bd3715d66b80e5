"""Sinks that replace what they hold, sources that tell bad rows, patterns in a table, stored orders."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fluxbook.operators import reshape
from fluxbook.operators.names import NameBook, NamePattern, alias_table, clean_debtors, resolve_names, sure_literal
from fluxbook.sources import scans, schemas, sinks
from fluxbook.sources.schemas import _D, _I, _S, _schema

TABLE = _schema(year=_I, country=_S, value=_D)


@pytest.fixture
def path(spark):
    return sinks.shared_folder(spark, "sources")


def test_a_year_has_few_files(spark, path):
    rows = spark.range(4000).repartition(40).select((F.col("id") % 5 + 2000).cast("int").alias("year"), F.col("id").alias("v"))
    sinks.write_parquet(rows, path)
    assert {d.name: len(list(d.glob("*.parquet"))) for d in Path(path).glob("year=*")} == {f"year={y}": 1 for y in range(2000, 2005)}
    assert spark.read.parquet(path).count() == 4000


def test_a_rerun_replaces_only_its_years(spark, frame, path, table_rows):
    sinks.write_parquet(frame([(2000, "a"), (2001, "b"), (None, "n")], "year int, v string"), path)
    sinks.write_parquet(frame([(2001, "c"), (2001, "d"), (2002, "e")], "year int, v string"), path)
    assert table_rows(spark.read.parquet(path), "year", "v") == [(2000, "a"), (2001, "c"), (2001, "d"), (2002, "e"), (None, "n")]
    sinks.write_parquet(frame([], "year int, v string"), path)
    assert spark.read.parquet(path).count() == 5
    sinks.write_parquet(frame([(2003, "f")], "year int, v string"), path, whole=True)
    assert table_rows(spark.read.parquet(path), "year", "v") == [(2003, "f")]
    sinks.write_parquet(frame([(1, "x")], "year int, v string"), path + "-flat", partition_by=None)
    assert spark.read.parquet(path + "-flat").count() == 1


def test_bad_rows_come_back_as_text(spark, tmp_path, table_rows):
    file = tmp_path / "t.csv"
    file.write_text("year,country,value\n2000,France,1.5\n2001x,Kenya,2\n2002,Chad\n2003,Mali,3,4\n2004,,\n")
    assert table_rows(scans.read_csv(spark, str(file), TABLE)) == [(2000, "France", 1.5), (2004, None, None)]
    bad = scans.bad_csv_rows(spark, str(file), TABLE)
    assert sorted(r["bad_row"] for r in bad.collect()) == ["2001x,Kenya,2", "2002,Chad", "2003,Mali,3,4"]
    assert {r["bad_row"]: tuple(r["read"]) for r in bad.collect()}["2001x,Kenya,2"] == (None, "Kenya", 2.0)
    assert scans.read_csv_rows(spark, str(file), TABLE).count() == 5
    other = tmp_path / "o.csv"
    other.write_text("year,value,country\n2000,1.5,France\n")
    with pytest.raises(Exception, match="(?i)header"):
        scans.read_csv(spark, str(other), TABLE).collect()
    empty = tmp_path / "e.csv"
    empty.write_text("year,country,value\n")
    assert scans.read_csv(spark, str(empty), TABLE).collect() == []


@pytest.mark.parametrize("pattern, literal", [
    ("(?i)^niger$", "niger"), ("nig(er)?ia", "nig"), ("a|b", ""), ("cote.*ivoire", "ivoire"), (r"st\. kitts", "st. kitts"), (r"a\dbcd", "bcd"), ("colou?r", "colo"),
    ("ab+cd", "ab"), ("x{2}yz", "yz"), ("[abc]def", "def"), ("(a|(b))tail", "tail"), ("", ""), (r"\Qa.b\E", ""), ("Ünd Land", "nd land"), ("(?x) a b", ""),
])
def test_what_every_match_holds(pattern, literal):
    assert sure_literal(pattern) == literal


def test_patterns_in_a_table(spark, frame, table_rows):
    """300 patterns, in a table and as a sequence: what trying them one by one gives, and no expression grows with them."""
    import re

    rng = random.Random(5)
    names = ["".join(rng.choices("abcdeé ", k=rng.randint(0, 9))) for _ in range(200)] + [None, "Ab"]
    bits = ["".join(rng.choices("abcde", k=rng.randint(1, 4))) for _ in range(300)]
    shapes = ["(?i){}", "^{}$", "{}.", "{}|e{}", "[{}]b", "x?{}", "({})+ ", "{}{{1,2}}a"]
    patterns = [NamePattern(rng.choice(shapes).replace("{}", b).replace("{{", "{").replace("}}", "}"), f"I{n}", f"N{n}", None) for n, b in enumerate(bits)]
    aliases = alias_table(spark, [("Ab", "ALI", None, "Somewhere")])
    listed = frame([(n,) for n in names], "country string")
    wanted = set()
    for name in set(names):
        hit = next((p for p in patterns if name is not None and re.search(p.pattern, name)), None)
        iso, short = (hit.iso_code, hit.name) if hit else (None, None)
        wanted.add((name, "ALI" if name == "Ab" else iso, short, "Somewhere" if name == "Ab" else None))
    assert {tuple(r) for r in resolve_names(listed, NameBook(aliases, patterns)).collect()} == wanted
    table = spark.createDataFrame([(n, p.pattern, p.iso_code, p.name, p.continent) for n, p in enumerate(patterns)][::-1], "rank long, pattern string, iso_code string, name string, continent string")
    resolved = resolve_names(listed, NameBook(aliases, table))
    assert {tuple(r) for r in resolved.collect()} == wanted
    assert "CASE" not in resolved._jdf.queryExecution().optimizedPlan().toString()
    assert clean_debtors(listed, "country", NameBook(aliases, patterns)).count() == len(names)


def test_ranks_are_stored(spark, table_rows):
    rows = spark.range(1000).repartition(16).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("k"))
    placed = reshape.with_rank(rows, [F.col("k").desc(), F.col("v").asc()])
    found = placed.collect()
    assert sorted((r["rank"], r["k"], r["v"]) for r in found) == [(n + 1, k, v) for n, (k, v) in enumerate(sorted(((r["k"], r["v"]) for r in found), key=lambda x: (-x[0], x[1])))]
    assert reshape.with_rank(rows.limit(0), [F.col("v")]).collect() == []
