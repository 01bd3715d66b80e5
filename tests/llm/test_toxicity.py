"""Operator 13: the machine against its formula, and what it finds on held-out rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxbook.llm.toxicity import MachineSettings, fit_machine, machine_logits, op13_toxicity, score_toxicity

PLAIN = [a + b for a in ("ba", "ke", "lo", "mi", "tu") for b in ("na", "re", "ti", "su", "vo", "dal")]


def test_logits_are_sums_over_pairs():
    rng = np.random.default_rng(1)
    weights, vectors = rng.normal(size=7), rng.normal(size=(7, 3))
    rows, terms, x = np.array([0, 0, 0, 2, 2]), np.array([1, 4, 6, 0, 1]), np.array([1.0, 2.0, 1.5, 1.0, 3.0])
    found, _ = machine_logits(rows, terms, x, 3, 0.3, weights, vectors)
    for row in range(3):
        own = [(t, v) for r, t, v in zip(rows, terms, x) if r == row]
        wanted = 0.3 + sum(weights[t] * v for t, v in own)
        wanted += sum(vectors[a] @ vectors[b] * v * w for i, (a, v) in enumerate(own) for b, w in own[i + 1:])
        assert found[row] == pytest.approx(wanted)


def test_pairs_are_learned():
    """Two terms that are harmless alone and toxic together: no sum of weights can tell that."""
    rows, terms, toxic = [], [], []
    for i in range(400):
        own = [k for k in (0, 1) if i >> k & 1]
        rows += [i] * len(own)
        terms += own
        toxic.append(float(own == [0, 1]))
    rows, terms, x = np.array(rows), np.array(terms), np.ones(len(rows))
    held = fit_machine(rows, terms, x, np.array(toxic), 2, MachineSettings())
    logits, _ = machine_logits(rows, terms, x, 400, *held)
    assert ((logits > 0) == (np.array(toxic) > 0)).all()
    linear = fit_machine(rows, terms, x, np.array(toxic), 2, MachineSettings(factors=0, shrink=0.0))
    alone, _ = machine_logits(rows, terms, x, 400, *linear)
    assert logits[3] - logits[1] - logits[2] + logits[0] > alone[3] - alone[1] - alone[2] + alone[0] + 1


def test_held_out_rows(frame):
    """Insults of several words, some only toxic with a group's name; clean texts of any length are left alone."""
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(1500):
        words = rng.choices(PLAIN, k=rng.choice([5, 30, 400]))
        kind = rng.choice(["clean", "clean", "insult", "both", "group"])
        if kind in ("insult", "both"):
            words += rng.choices(["Scrumf", "blerg"], k=1)
        if kind in ("both", "group"):
            words += ["Zorgs"]
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(kind == "both")))
    scored = score_toxicity(frame(docs, "doc_id long, text string"), frame(labels, "doc_id long, quality int, toxic int"), F.col("doc_id") % 4 != 2)
    found = {r["doc_id"]: r["score"] >= 0.3 for r in scored.collect() if r["doc_id"] % 4 == 2}
    truth = {i: toxic == 1 for i, _, toxic in labels if i % 4 == 2}
    assert sum(found[i] for i in truth if truth[i]) >= 0.95 * sum(truth.values())
    assert sum(found[i] for i in truth if not truth[i]) <= 0.02 * len(truth)


def test_given_documents(spark):
    folder = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op13_toxicity(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    caught = sum(r["predicted"] for r in held if toxic[r["doc_id"]])
    assert caught >= 0.88 * sum(toxic[r["doc_id"]] for r in held)
    assert sum(r["predicted"] for r in held if not toxic[r["doc_id"]]) <= 0.01 * len(held)


def test_labels_do_not_reach_the_held_out(frame):
    """Other labels of held-out rows change no score, nor do rows of no use."""
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(PLAIN, k=20)) + (" blerg" if i % 3 == 0 else "")) for i in range(200)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(200)]
    turned = [(i, q, 1 - t if i % 4 == 2 else t) for i, q, t in labels] + [(None, 1, 1), (7, 1, None), (10_000, 0, 1)] + labels[:3]
    run = lambda own: {r["doc_id"]: r["score"] for r in score_toxicity(frame(docs, "doc_id long, text string"), frame(own, "doc_id long, quality int, toxic int"), F.col("doc_id") % 4 != 2).collect()}
    assert run(labels) == run(turned)


def test_edges(frame, documents, no_documents):
    labels = frame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    nobody = frame([], "doc_id long, quality int, toxic int")
    assert score_toxicity(no_documents, labels, F.lit(True)).collect() == []
    assert {r["score"] for r in score_toxicity(documents, nobody, F.lit(True)).collect()} == {0.5}
    for kept in (F.lit(True), F.lit(None).cast("boolean")):
        scored = score_toxicity(documents, labels, kept).collect()
        assert len(scored) == documents.count() and all(0 <= r["score"] <= 1 for r in scored)
    only = frame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in score_toxicity(documents, only, F.lit(True)).collect())
