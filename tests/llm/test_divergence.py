"""Operator 12: the tree of term rows against SQL over all terms and pairs."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fluxbook.llm import divergence
from fluxbook.llm.divergence import OP12_SQL, audit_sources, op12_source_divergence


def by_sql(table, least=10):
    con = duckdb.connect()
    con.register("documents", table)
    return sorted(con.execute(OP12_SQL.replace(">= 10", f">= {least}")).fetchall(), key=str)


def docs_table(rows):
    return pa.table({n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate(("text", "lang", "source"))})


@pytest.fixture(scope="module")
def uneven_rows():
    """Sources of very different sizes, terms shared by all and by few, NULLs, empty texts, one long text, repeated rows."""
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ba", "Ke", "ö", "李", "x") for b in ("na", "RE", "é", "su", "")]
    rows = []
    for _ in range(400):
        lang = rng.choices(["en", "de", None], [8, 2, 1])[0]
        source = rng.choices(["web", "book", "code", "wiki", "é", None], [40, 6, 4, 2, 1, 1])[0]
        n = rng.choice([0, 1, 3, 20])
        rows.append((rng.choice(["-", " ", "1", "@"]).join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=n)), lang, source))
    rows += [(None, "en", "web"), (None, "fr", "only"), ("", "fr", "other"), ("ba", "it", "alone")] + [rows[0]] * 5
    rows.append((" ".join(rng.choice(words) for _ in range(60_000)), "en", "book"))
    return rows


@pytest.mark.parametrize("pairs", [1, divergence.PAIRS])
def test_against_sql(frame, uneven_rows, folder, pairs, monkeypatch):
    spark = frame([], "a int").sparkSession
    table = docs_table(uneven_rows)
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    found = sorted([tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in op12_source_divergence(spark, folder(documents=table)).collect()], key=str)
    assert found == by_sql(table) and len(found) > 60


def test_nodes_cut_by_batches(frame, uneven_rows):
    """A node whose paths lie in several batches counts by its parts."""
    spark = frame([], "a int").sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = sorted([tuple(r) for r in audit_sources(frame(uneven_rows, "text string, lang string, source string"), least=1).collect()], key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == by_sql(docs_table(uneven_rows), 1)


def test_edges(frame, documents, no_documents):
    assert audit_sources(no_documents).collect() == []
    few = frame([(None, None, None, 1), ("a", "x", "s", 2), ("b", "x", "t", 3)], "text string, lang string, source string, place int")
    assert sorted(tuple(r) for r in audit_sources(few).collect()) == [("x", "s", "pair", "t", 0, 1), ("x", "t", "pair", "s", 0, 1)]
    assert audit_sources(documents).count() > 0
