"""The corpus pipeline stage by stage, and the registration of its queries."""

import pyarrow as pa
import pytest

import __spark_entry__
import corpus_pipeline
from test_secrets import brute as secrets_in
from test_shingle_join import brute as components, shingles


@pytest.fixture(scope="module")
def sf_dir(folder, document_table, corpus):
    passage = "which wooden bridge over the narrow river was built by local people long before any road had reached the village"
    texts = document_table.append_column("extra", pa.array([passage] * document_table.num_rows))
    held = {11, 12}
    rows = [f"{t} {passage} {t}" if i in held else t for i, t in zip(texts["doc_id"].to_pylist(), texts["text"].to_pylist())]
    texts = texts.drop_columns("extra").set_column(1, "text", pa.array(rows))
    ids = [i for i in texts["doc_id"].to_pylist() if i is not None]
    labels = pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array([int(i % 3 > 0) for i in ids], pa.int32()), "toxic": pa.array([0 for _ in ids], pa.int32())})
    return folder(documents=texts, benchmark=pa.table({"item_id": pa.array([1], pa.int64()), "text": [passage]}), labels=labels)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    pairs = lambda df: sorted([(r["doc_id"], r["text"]) for r in df.collect()], key=str)
    by_name = dict(corpus_pipeline.STAGES)
    assert len(by_name) == 5

    kept = by_name["quality classifier"](spark, docs, sf_dir)
    assert kept.columns == columns and set(pairs(kept)) <= set(pairs(docs))

    one = by_name["n-gram Jaccard join"](spark, docs, sf_dir)
    wanted = {c for own, n, c in components(pairs(docs)) if n and own is not None}
    assert one.columns == columns and sorted(i for i, t in pairs(one) if shingles(t)) == sorted(wanted)

    clean = by_name["benchmark decontamination"](spark, docs, sf_dir)
    assert clean.columns == columns
    assert {i for i, _ in set(pairs(docs)) - set(pairs(clean))} == {11, 12}

    masked = by_name["secret scans"](spark, docs, sf_dir)
    assert masked.schema == docs.schema and masked.count() == docs.count()
    assert not any(secrets_in(t) for _, t in pairs(masked))
    assert all(r["n_chars"] == len(r["text"]) for r in masked.collect() if r["text"] is not None)


def test_run_applies_every_stage(spark, sf_dir):
    expected = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        expected = stage(spark, expected, sf_dir)
    key = lambda df: sorted([tuple(r) for r in df.select("doc_id", "text", "taken").collect()], key=str)
    found = key(corpus_pipeline.run(spark, sf_dir))
    assert found == key(expected)
    assert not {11, 12} & {r[0] for r in found}
    assert found and all(text and taken > 0 and len(text.split()) == taken for _, text, taken in found)


def test_empty_tables(spark, folder, document_table):
    empty = folder(
        documents=document_table.slice(0, 0), benchmark=pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}),
        labels=pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32()), "toxic": pa.array([], pa.int32())}),
    )
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_registration():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    numbers = sorted(int(q[2:].split("_")[0]) for q in queries if q.startswith("op") and q[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in queries
    assert set(sql) <= set(queries)
