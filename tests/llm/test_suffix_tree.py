"""Operator 8: counts and base score against plain loops, and what the model adds on held-out texts."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fluxbook.llm import suffix_tree
from fluxbook.llm.suffix_tree import TreeSettings, op8_lm_scores, score_texts


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def held(own):
    return own is not None and zlib.crc32(str(own).encode()) % 7 == 2


def brute(rows):
    counts = Counter()
    for own, text in rows:
        if not held(own):
            counts.update(words_of(text) + [None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for own, text in rows:
        tokens = words_of(text) + [None]
        out.append((own, held(own), len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)))
    return sorted(out, key=lambda r: str(r[:4]))


def condition():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def test_counts_and_base_score(documents, corpus):
    found = sorted([tuple(r) for r in score_texts(documents, condition()).collect()], key=lambda r: str(r[:4]))
    wanted = brute([(r[0], r[1]) for r in corpus])
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    assert [r[5] for r in found] == pytest.approx([r[5] for r in wanted])
    assert all(math.isfinite(r[6]) and r[6] < 0 for r in found)


def line_of(text):
    return b"".join(w.encode() + b" " for w in words_of(text))[:-1] + b"\n"


def tree_score(rows, depth, settings):
    """Scores by plain loops: counts of every context, contexts retained by what they tell about their own occurrences."""
    counts = Counter()
    for own, text in rows:
        if not held(own):
            line = b"\n" * depth + line_of(text)
            for i in range(depth, len(line)):
                for d in range(depth + 1):
                    counts[line[i - d:i], line[i]] += 1
    totals = Counter()
    for (context, _), n in counts.items():
        totals[context] += n
    logs, kept = {}, set()

    def log(context, symbol):
        """From the longest retained suffix."""
        while context and context not in kept:
            context = context[1:]
        if (context, symbol) not in logs:
            n = counts[context, symbol]
            if not context:
                logs[context, symbol] = math.log10((n + 1) / (totals[b""] + 256))
            else:
                logs[context, symbol] = math.log10((n + settings.drawn * 10 ** log(context[1:], symbol)) / (totals[context] + settings.drawn))
        return logs[context, symbol]

    following = {}
    for (context, symbol), n in counts.items():
        following.setdefault(context, []).append((symbol, n))
    for d in range(1, depth + 1):
        for context in [c for c in following if len(c) == d]:
            gain = 0.0
            for symbol, n in following[context]:
                p = 10 ** log(context[1:], symbol)
                gain += n * (math.log((n - 1 + settings.drawn * p) / (totals[context] - 1 + settings.drawn)) - math.log(p))
            if gain >= settings.evidence - 1e-9 and gain >= settings.divergence * totals[context]:
                kept.add(context)
    out = {}
    for own, text in rows:
        line = b"\n" * depth + line_of(text)
        out[own] = sum(log(line[i - depth:i], line[i]) for i in range(depth, len(line)))
    return out, len(kept)


@pytest.mark.parametrize("piece, chunk", [(1 << 20, 32 << 20), (40, 300)])
def test_scores_by_loops(frame, piece, chunk, monkeypatch):
    """Whatever the pieces and chunks."""
    monkeypatch.setattr(suffix_tree, "PIECE_BYTES", piece)
    monkeypatch.setattr(suffix_tree, "CHUNK_BYTES", chunk)
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices(["a", "b", "é", "C", "d"], k=rng.randint(1, 6))) for _ in range(30)]
    rows = [(i, (" " if i % 2 else "\n\t").join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 60])))) for i in range(60)] + [(70, None), (71, " "), (72, "x" * 300 + "  " + "y" * 90 + " ")]
    settings = TreeSettings(depth=3, evidence=3.0)
    wanted, kept = tree_score(rows, 3, settings)
    assert kept > 30
    docs = frame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in score_texts(docs, condition(), settings=settings).collect()}
    assert found == pytest.approx(wanted)


def test_probabilities(frame):
    """Probabilities of all texts of up to two letters add up to less than one, those of the bytes behind a context to one."""
    rng = random.Random(8)
    train = [(i, " ".join(rng.choices(["ab", "ba", "a", "b"], k=5)), False) for i in range(40)]
    ask = [(1000 + i, w, True) for i, w in enumerate(["", "a", "b", "aa", "ab", "ba", "bb", "a a", "a b", "b a", "b b"])]
    found = score_texts(frame(train + ask, "doc_id long, text string, held boolean"), F.col("held")).filter("held_out").collect()
    assert 0.0 < sum(10 ** r["score"] for r in found) < 1.0


def test_better_than_words_on_given_documents(spark):
    """Held-out texts are likelier than by counts of their words with unseen words spelt by equally likely bytes, which
    is a distribution over all texts as well; ``base_score`` is none, as it gives every unseen word the share of one."""
    folder = "/root/testdata/sf0.1"
    docs = [(r["doc_id"], words_of(r["text"])) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    counts = Counter(w for own, words in docs if not held(own) for w in words)
    ends, n, once = sum(not held(own) for own, _ in docs), sum(counts.values()), sum(c == 1 for c in counts.values())
    stop = (ends + 1) / (n + ends + 2)
    spelt = lambda w: math.log10(once) - (len(w.encode()) + 1) * math.log10(256)
    uniform = {
        own: sum((math.log10(counts[w]) if counts[w] else spelt(w)) - math.log10(n + once) + math.log10(1 - stop) for w in words) + math.log10(stop)
        for own, words in docs if held(own)
    }
    rows = [r for r in op8_lm_scores(spark, folder).collect() if r["held_out"]]
    assert {r["doc_id"] for r in rows} == uniform.keys() and len(rows) > 10
    total = sum(r["score"] for r in rows)
    assert total > 0.95 * sum(uniform.values())
    assert total > sum(r["base_score"] for r in rows)


def test_word_order_counts(frame):
    """Contexts reach over words: a text in the order of the training texts is likelier than its words in another one."""
    rng = random.Random(9)
    line = [f"w{i}" for i in range(12)]
    train = [(i, " ".join(line if i % 2 else rng.sample(line, 12)), False) for i in range(80)]
    ask = [(1000, " ".join(line), True), (1001, " ".join(line[::-1]), True)]
    found = {r["doc_id"]: r for r in score_texts(frame(train + ask, "doc_id long, text string, held boolean"), F.col("held")).filter("held_out").collect()}
    assert found[1000]["base_score"] == pytest.approx(found[1001]["base_score"])
    assert found[1000]["score"] > found[1001]["score"] + 1


def test_rare_contexts_are_tested_too(spark):
    """A context is judged by its own count, not by its share of the corpus: here one in 200000 words."""
    def line(i):
        return "zeta omega" if i % 10_000 == 0 else " ".join(f"v{(i * 7919 + k * 104729) % 997}" for k in range(20))

    docs = spark.createDataFrame([(i, line(i), False) for i in range(100_000)] + [(200_000, "zeta omega", True), (200_001, "omega zeta", True)], "doc_id long, text string, held boolean")
    found = {r["doc_id"]: r["score"] for r in score_texts(docs, F.col("held")).filter("held_out").collect()}
    assert found[200_000] > found[200_001] + 2


def test_edges(frame, no_documents):
    assert score_texts(no_documents, F.lit(False)).collect() == []
    docs = frame([(1, None, 5), (2, "", 5), (None, "a a", 5), (1, None, 5)], "doc_id long, text string, word int")
    for of in (F.lit(True), F.lit(False), F.lit(None).cast("boolean")):
        found = score_texts(docs, of).collect()
        assert sorted(r["n_tokens"] for r in found) == [1, 1, 1, 3]
        assert all(math.isfinite(r["score"]) for r in found)
