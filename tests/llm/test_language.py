"""Operator 6: held-out accuracy, and that only the text decides."""

import math
import pickle
import random
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fluxbook.llm.language import LanguageSettings, fit_languages, op6_language_id, predict_language

SYLLABLES = {"aa": "ba ka la mo ni".split(), "bb": "sch ver ung kei ste".split(), "cc": "ção lhe que nho dos".split()}


def _corpus(n):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(12)), lang))
    return rows


def test_held_out_accuracy(frame):
    rows = _corpus(400)
    docs = frame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in predict_language(docs, F.col("doc_id") % 4 != 2).collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    assert sum(found[i]["lang_pred"] == lang for i, _, lang in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_unseen_words_fall_back_to_ngrams(frame):
    rows = [(i, t, "aa") for i, t in enumerate(["kalamo nikala"] * 4)] + [(i + 9, t, "bb") for i, t in enumerate(["verschung steverkei"] * 4)]
    rows += [(50, "lamonika", None), (51, "schungver", None)]
    found = {r["doc_id"]: r["lang_pred"] for r in predict_language(frame(rows, "doc_id long, text string, lang string"), F.lit(True)).collect()}
    assert (found[50], found[51]) == ("aa", "bb")


def test_only_the_text_decides(frame):
    rows = _corpus(80)
    swapped = [(i, t, lang if i % 4 != 2 else "zz") for i, t, lang in rows]
    predict = lambda r: sorted((x["doc_id"], x["lang_pred"], x["score"]) for x in predict_language(frame(r, "doc_id long, text string, lang string"), F.col("doc_id") % 4 != 2).collect())
    assert predict(rows) == predict(swapped)


def test_edges(documents, corpus, no_documents):
    found = predict_language(documents, F.col("doc_id") % 4 != 2).collect()
    assert len(found) == len(corpus)
    letterless = {r[0] for r in corpus if r[0] is not None and not any(map(str.isalpha, r[1] or ""))}
    assert {r["doc_id"] for r in found if r["lang_pred"] == "und" and r["doc_id"] is not None} == letterless
    assert all(r["lang_pred"] in ("de", "en", "und") for r in found)
    assert predict_language(no_documents, F.lit(True)).collect() == []
    assert {r["lang_pred"] for r in predict_language(documents, F.lit(False)).collect()} == {"und"}


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    truth = spark.read.parquet(f"{folder}/documents.parquet").filter("lang is not null").select("doc_id", "lang")
    held = op6_language_id(spark, folder).filter("held_out").join(truth, "doc_id")
    assert held.filter("lang_pred = lang").count() >= 0.9 * held.count() > 0


def by_loops(rows, learned, settings):
    """Language and posterior of every text of small ASCII letters: log frequencies of known words, else the mean of the
    longest known n-grams of the word."""
    counts = {}
    for i, text, lang in rows:
        if lang and learned(i):
            for word in text.split():
                for length in range(settings.longest + 1):
                    for gram in [word[k:k + length] for k in range(len(word) - length + 1)] if length else [word]:
                        counts.setdefault(length, {}).setdefault(lang, Counter())[gram] += 1
    languages = sorted(counts[0])
    known = {n: {g for c in own.values() for g, k in c.items() if k >= settings.least} for n, own in counts.items()}

    def log(length, lang, gram):
        n = counts[length][lang][gram]
        of = sum(counts[length][lang].values()) + settings.added * max(len(known[length]), 1)
        return math.log(((n if n >= settings.least else 0) + settings.added) / of)

    out = {}
    for i, text, _ in rows:
        total = dict.fromkeys(languages, 0.0)
        for word in text.split():
            if word in known[0]:
                for lang in languages:
                    total[lang] += log(0, lang, word)
                continue
            for length in range(settings.longest, 0, -1):
                hits = [word[k:k + length] for k in range(len(word) - length + 1) if word[k:k + length] in known[length]]
                if hits:
                    for lang in languages:
                        total[lang] += sum(log(length, lang, g) for g in hits) / len(hits)
                    break
        best = max(languages, key=lambda x: (total[x], [-ord(c) for c in x]))
        out[i] = (best, 1 / sum(math.exp(v - total[best]) for v in total.values()))
    return out


def test_scores_by_loops(frame):
    rng = random.Random(9)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "aeg"}
    rows = []
    for i in range(120):
        lang = rng.choice(list(letters))
        rows.append((i, " ".join("".join(rng.choices(letters[lang], k=rng.randint(1, 5))) for _ in range(rng.randint(1, 8))), lang if i % 10 else None))
    wanted = by_loops(rows, lambda i: i % 3, LanguageSettings())
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict_language(frame(rows, "doc_id long, text string, lang string"), F.col("doc_id") % 3 != 0).collect()}
    assert {i: v[0] for i, v in found.items()} == {i: v[0] for i, v in wanted.items()}
    assert {i: v[1] for i, v in found.items()} == pytest.approx({i: v[1] for i, v in wanted.items()})


def test_the_model_is_shipped_without_the_package(frame, tmp_path):
    """What workers get can be read where this package cannot be imported."""
    model = fit_languages(frame(_corpus(40), "id long, text string, lang string"), LanguageSettings())
    file = tmp_path / "model"
    file.write_bytes(pickle.dumps((model.languages, model.tables)))
    read = f"import pickle, sys; sys.path = [p for p in sys.path if p]; print(pickle.load(open({str(file)!r}, 'rb'))[0])"
    out = subprocess.run([sys.executable, "-c", read], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=True)
    assert out.stdout.strip() == str(model.languages)
