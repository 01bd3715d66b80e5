"""Operator 6: language identification by known words first, then shorter character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fluxbook.llm.staging import staged
from fluxbook.llm.texts import AS_IS, U64, lowered, map_texts, span_hashes, spans_of, text_slices

UNKNOWN = "und"
IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True


@dataclass(frozen=True)
class LanguageSettings:
    """``documents``: about how many labelled documents of each language are learned from,
    chosen by the hashes of their ids; all of their words and n-grams up to ``longest`` that have the count ``least`` in a
    language are known. ``added``: smoothing count."""

    documents: int = 4000
    longest: int = 4
    least: int = 2
    added: float = 0.5
    seed: int = 6


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    small = lowered(data)
    starts, ends, rows = spans_of(IS_LETTER[small], offsets)
    return small, starts, ends, rows


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``length`` characters in each span and the span of each run."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    head = (data[at] & 0xC0) != 0x80
    at, owner = at[head], owner[head]
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    until = np.append(at[1:], 0) if len(at) else at
    until = np.where(last, ends[owner], until) if len(at) else until
    n = len(at) - length + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    whole = owner[:n] == owner[length - 1:]
    return span_hashes(data, at[:n][whole], until[length - 1:][whole], AS_IS), owner[:n][whole]


def _counted(settings: LanguageSettings, languages: list[str]):
    """Per batch the counts of words (length 0) and n-grams of each language."""
    number = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang_all = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for first, end, data, offsets in text_slices(batch.column(1)):
                small, starts, ends, rows = _words(data, offsets)
                lang = lang_all[first:end]
                for length in range(settings.longest + 1):
                    if length:
                        keys, owner = _grams(small, starts, ends, length)
                        of = lang[rows[owner]]
                    else:
                        keys, of = span_hashes(small, starts, ends), lang[rows]
                    for i in range(len(languages)):
                        found, n = np.unique(keys[of == i], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(found), i, np.int32)), pa.array(np.full(len(found), length, np.int32)), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))],
                            names=["lang", "length", "gram", "n"],
                        )

    return run


class LanguageModel:
    """Log frequencies of words and n-grams in each language, by sorted hashes."""

    def __init__(self, languages: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.languages, self.tables = languages, tables

    def lookup(self, length: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, logs = self.tables[length]
        if not len(hashes):
            return np.zeros(len(keys), bool), np.zeros((len(keys), len(self.languages)))
        place = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        return hashes[place] == keys, logs[place]

    def word_scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """A known word scores by its log frequencies; else the mean of the known n-grams of the
        greatest length that has any counts; a word without known characters says nothing."""
        known, scores = self.lookup(0, keys)
        scores = np.where(known[:, None], scores, 0.0)
        todo = np.flatnonzero(~known)
        for length in sorted(self.tables, reverse=True):
            if not length or not len(todo):
                break
            grams, owner = _grams(data, starts[todo], ends[todo], length)
            hit, logs = self.lookup(length, grams)
            n = np.bincount(owner[hit], minlength=len(todo))
            got = n > 0
            for i in range(len(self.languages)):
                total = np.bincount(owner[hit], logs[hit, i], minlength=len(todo))
                scores[todo[got], i] = total[got] / n[got]
            todo = todo[~got]
        return scores


def fit_languages(labelled: DataFrame, settings: LanguageSettings) -> LanguageModel:
    """A model from rows of ``id``, ``text``, ``lang`` without NULLs in text and lang."""
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], {n: (np.zeros(0, U64), np.zeros((0, 0))) for n in range(settings.longest + 1)})
    rate = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, settings.documents / sizes[name])))])[F.col("lang")]
    part = F.pmod(F.xxhash64("id", F.lit(settings.seed)), F.lit(1 << 20)) / float(1 << 20)
    counts = (
        labelled.filter(part < rate).select("lang", "text").mapInArrow(_counted(settings, languages), "lang int, length int, gram long, n long")
        .groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))
    )
    counts = staged(counts, "lang-counts")
    totals = {(r["lang"], r["length"]): r["n"] for r in counts.groupBy("lang", "length").agg(F.sum("n").alias("n")).collect()}
    chosen = counts.filter(F.col("n") >= settings.least).toPandas()  # bounded by the documents learned from
    tables = {}
    for length in range(settings.longest + 1):
        own = chosen[chosen["length"] == length]
        hashes, which = np.unique(own["gram"].to_numpy(np.int64).view(U64), return_inverse=True)
        n = np.full((len(hashes), len(languages)), settings.added)
        np.add.at(n, (which, own["lang"].to_numpy(np.int64)), own["n"].to_numpy(float))
        of = np.array([totals.get((i, length), 0) + settings.added * max(len(hashes), 1) for i in range(len(languages))])
        tables[length] = (hashes, np.log(n / of))
    return LanguageModel(languages, tables)


def _predicting(broadcast):
    model = LanguageModel(*broadcast.value)
    n = len(model.languages)

    def kernel(batch, first, end, data, offsets):
        small, starts, ends, rows = _words(data, offsets)
        keys, example, which = np.unique(span_hashes(small, starts, ends), return_index=True, return_inverse=True)
        # a span's end must not descend, so the examples are scored in the order of the text
        order = np.argsort(example)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        scores = model.word_scores(small, starts[example[order]], ends[example[order]], keys[order])[place[which]]
        size = end - first
        total = np.column_stack([np.bincount(rows, scores[:, i], minlength=size) for i in range(n)]) if n else np.zeros((size, 0))
        ascii_letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum(IS_LETTER[data] & (data < 128), out=ascii_letters[1:])
        has = np.diff(ascii_letters[offsets]) > 0
        for row in np.flatnonzero(~has & (np.diff(offsets) > 0)):
            has[row] = any(map(str.isalpha, data[offsets[row]:offsets[row + 1]].tobytes().decode()))
        if not n:
            return {"lang_pred": [UNKNOWN] * size, "score": np.zeros(size)}
        best = total.argmax(1)
        score = 1.0 / np.exp(total - total.max(1)[:, None]).sum(1)
        return {
            "lang_pred": [model.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())],
            "score": np.where(has, score, 0.0),
        }

    return kernel


def predict_language(
    docs: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: LanguageSettings = LanguageSettings(),
) -> DataFrame:
    """The id, ``lang_pred`` and ``score`` (the posterior among the learned languages) of every document.

    Learns from a bounded sample of the documents where ``learned`` holds and text and language
    are not NULL; predicts from the text alone. A word that the model knows scores by its log
    frequency in each language, another one by its longest known character n-grams. Texts that
    are NULL or have no letter are ``und`` with score 0, as are all if nothing can be learned.
    Ties go to the first language in code-point order. Repeated rows are predicted each; an
    empty table gives no rows; other columns are left aside.
    """
    labelled = docs.filter(F.coalesce(learned, F.lit(False)) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    model = fit_languages(labelled, settings)
    # plain arrays: workers need no class of this package to read them
    model = docs.sparkSession.sparkContext.broadcast((model.languages, model.tables))
    added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_texts(docs, text_col, [id_col], added, lambda: _predicting(model))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    predicted = predict_language(docs, remainder != 2)
    return predicted.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
