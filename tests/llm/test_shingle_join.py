"""Operator 2 against a comparison of all pairs."""

import random
import re

import pytest

from fluxbook.llm import shingle_join
from fluxbook.llm.shingle_join import join_near_duplicates, keep_one_each


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                up[top(i)] = top(j)
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None and sets[i]:
            least[top(i)] = min(own, least.get(top(i), own))
    return sorted([(own, len(s), own if not s else least.get(top(i))) for i, ((own, _), s) in enumerate(zip(rows, sets))], key=str)


def found(docs):
    return sorted([tuple(r) for r in join_near_duplicates(docs).drop("class").collect()], key=str)


def test_equals_all_pairs(documents, corpus):
    assert found(documents) == brute([(r[0], r[1]) for r in corpus])


@pytest.mark.parametrize("chunk", [512, 8])
def test_chains_and_frequent_shingles(frame, monkeypatch, chunk):
    """Chains whose ends are not similar, pairs on either side of 75 %, one passage in all texts; blocks of several parts too."""
    monkeypatch.setattr(shingle_join, "CHUNK", chunk)
    rng = random.Random(chunk)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(12):
        own = [word() for _ in range(rng.randint(10, 60))]
        for _ in range(10):
            texts.append(" ".join(own + passage))
            for _ in range(rng.randint(1, 3)):
                own[rng.randrange(len(own))] = word()
    for n in (23, 24, 25, 31, 32, 39, 40):  # one change at the end costs one to five shingles
        own = [word() for _ in range(n)]
        for cut in range(1, 9):
            texts.append(" ".join(own[:-cut] + [word() for _ in range(cut)]))
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = frame(rows, "doc_id long, text string").repartition(5)
    assert found(docs) == brute(rows)


def test_keeps_one_of_each(documents, corpus):
    kept = keep_one_each(documents)
    assert kept.columns == documents.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    components = {(own, component) for own, n, component in brute([(r[0], r[1]) for r in corpus]) if n and own is not None}
    assert sorted(own for own, text in rows if shingles(text)) == sorted({c for _, c in components})
    assert len([1 for _, text in rows if not shingles(text)]) == len([1 for r in corpus if not shingles(r[1])])


def test_empty(no_documents):
    assert join_near_duplicates(no_documents).collect() == []
    assert keep_one_each(no_documents).collect() == []
