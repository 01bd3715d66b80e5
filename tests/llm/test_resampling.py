"""Operator 9 on a corpus with a planted kind of bad text."""

import random

import pytest

from fluxbook.llm.resampling import resample


@pytest.fixture(scope="module")
def planted(frame):
    rng = random.Random(9)
    common = [f"w{i}" for i in range(150)]
    foul = [f"x{i}" for i in range(20)]
    rows, labels = [], []
    for i in range(1200):
        bad = i % 4 == 0
        rows.append((i, " ".join(rng.choice(foul) if bad and rng.random() < 0.3 else rng.choice(common) for _ in range(rng.randint(30, 80))), 1, 2))
        if i % 2 == (i // 4) % 2:
            labels.append((i, 0 if bad else 1, int(bad and i % 8 == 0)))
    return frame(rows, "doc_id long, text string, id int, mean int"), frame(labels, "doc_id long, quality int, toxic int")


def test_keeps_the_target_and_drops_the_rest(planted):
    docs, labels = planted
    rows = resample(docs, labels).collect()
    assert len(rows) == 1200
    good, bad = [r["kept"] for r in rows if r["doc_id"] % 4], [r["kept"] for r in rows if r["doc_id"] % 4 == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.1 * len(bad)
    lowest_kept, highest_out = min(r["key"] for r in rows if r["kept"]), max(r["key"] for r in rows if not r["kept"])
    assert lowest_kept >= highest_out
    again = {(r["doc_id"], r["kept"]) for r in resample(docs.repartition(5), labels).collect()}
    assert again == {(r["doc_id"], r["kept"]) for r in rows}


def test_edges(planted, documents, corpus, no_documents, frame):
    _, labels = planted
    assert len(resample(documents, labels).collect()) == len(corpus)
    assert all(r["kept"] for r in resample(documents, labels.limit(0)).collect())
    only_good = frame([(1, 1, 0), (2, 1, None), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in resample(documents, only_good).collect())
    assert resample(no_documents, labels).collect() == []
