"""Operator 1 against its SQL and the rules of the mix."""

import re
from collections import defaultdict

import pytest
from compare import compare, connect

from fluxbook.llm.mixing import OP1_SQL, mix_sources, mixed_texts, op1_mix_sources, source_targets


def test_equals_sql(spark, folder, document_table):
    path = folder(documents=document_table)
    assert compare(op1_mix_sources(spark, path), connect(path), OP1_SQL) is None


def test_rules_of_the_mix(documents, corpus):
    rows = mix_sources(documents).collect()
    assert len(rows) == len(corpus)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t[1] or "")) for t in corpus)
    assert sum(sizes.values()) == words
    assert sum(target.values()) == pytest.approx(words)
    for source, want in target.items():
        assert want <= 3 * sizes[source] * (1 + 1e-12)
        assert taken[source] == int(want) or abs(taken[source] - want) <= 1
    again = {(r["doc_id"], r["size"], r["taken"]) for r in mix_sources(documents.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["size"], r["taken"]) for r in rows}


def test_the_mixed_texts(documents, corpus):
    """Each document's rows are its whole text as often as the digest says, and once its first words at the cut."""
    wanted = defaultdict(list)
    for r in mix_sources(documents).collect():
        wanted[r["doc_id"], r["source"], r["size"]].append(r["taken"])
    out = mixed_texts(documents)
    assert out.columns == [*documents.columns, "taken"]
    found, words_of = defaultdict(list), {}
    given = defaultdict(set)
    for own, text, _, source, _ in corpus:
        given[own, source].add(text)
    for r in out.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        assert len(words) == r["taken"] > 0
        whole = [t for t in given[r["doc_id"], r["source"]] if t and t.startswith(r["text"])]
        assert whole and all(re.findall(r"[^\x20\x09-\x0D]+", t)[:len(words)] == words for t in whole)
        size = max(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in whole)
        found[r["doc_id"], r["source"], size].append(r["taken"])
    assert {k: sum(v) for k, v in found.items()} == {k: sum(v) for k, v in wanted.items() if sum(v)}
    cuts = [t for (_, _, size), rows in found.items() for t in rows if t < size]
    assert 0 < len(cuts) <= 4


def _targets(sizes):
    """Shares by weight, the excess over three times a source handed on until none is left."""
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in sizes if s not in fixed]
        if not open_:
            return fixed
        rest = total - sum(fixed.values())
        share = {s: rest * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 500, "c": 300}, {"a": 1, "b": 1, "c": 1, "d": 10_000}, {"x": 7}, {"a": 0, "b": 9}, {None: 40, "a": 3, "b": 2, "c": 900, "d": 1},
])
def test_targets_equal_resharing(frame, sizes):
    found = {r["source"]: r["target"] for r in source_targets(frame(list(sizes.items()), "source string, size long")).collect()}
    assert found == pytest.approx(_targets(sizes))


def test_empty(no_documents):
    assert mix_sources(no_documents).collect() == []
    assert mixed_texts(no_documents).collect() == []


def test_spaces_are_kept_at_the_cut(frame):
    docs = frame([(1, " a\n b\tc ", "x"), (2, "d", "y")], "doc_id long, text string, source string")
    out = {(r["text"], r["taken"]) for r in mixed_texts(docs, weights=(1, 1), most=2).collect()}
    assert out == {(" a\n b", 2), ("d", 1)}
