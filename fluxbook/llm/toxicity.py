"""Operator 13: toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fluxbook.llm.staging import staged
from fluxbook.llm.texts import U64, lowered, map_texts, span_hashes, spans_of, text_slices

#: Bytes of a term: ASCII letters and all of other characters.
IN_TERM = np.zeros(256, bool)
IN_TERM[65:91] = IN_TERM[97:123] = IN_TERM[128:] = True
BLOCK = 1 << 14


@dataclass(frozen=True)
class MachineSettings:
    """``sample``: most labelled rows that are learned from. ``buckets``: of the hashed terms.
    ``prefixes``: bytes of the beginnings of terms that are terms as well. ``z``: how far, in standard deviations,
    a bucket's share of toxic rows must be above that of all for it to be learned. ``toxic``: weight of a toxic row. ``factors``: length of a
    bucket's vector for pairs. ``shrink``: weight of the squared parameters."""

    sample: int = 20_000
    buckets: int = 1 << 18
    prefixes: tuple[int, ...] = (4, 6, 8)
    z: float = 2.5
    factors: int = 6
    toxic: float = 3.0
    shrink: float = 2e-5
    steps: int = 300
    rate: float = 0.05
    seed: str = "toxic"


@dataclass
class Machine:
    """log-odds = bias + sum of w x + sum over pairs of (v . v') x x', where x = log2(1 + count) of each learned term in a text."""

    place: np.ndarray  # of each bucket in the tables below, -1 for those that are not learned
    bias: float
    weights: np.ndarray
    vectors: np.ndarray


def terms_of(data: np.ndarray, offsets: np.ndarray, buckets: int, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each term, in small letters, and of the beginnings of longer terms."""
    small = lowered(data)
    starts, ends, rows = spans_of(IN_TERM[small], offsets)
    all_rows, all_hashes = [rows], [span_hashes(small, starts, ends)]
    for size in prefixes:
        longer = ends - starts > size
        all_rows.append(rows[longer])
        all_hashes.append(span_hashes(small, starts[longer], starts[longer] + size) + U64(size))
    return np.concatenate(all_rows), (np.concatenate(all_hashes) % U64(buckets)).astype(np.int64)


def _distinct(rows: np.ndarray, values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of row and value, and log2(1 + how often they occur)."""
    pairs, times = np.unique(rows * limit + values, return_counts=True)
    return pairs // limit, pairs % limit, np.log2(1.0 + times)


def _counting(settings: MachineSettings):
    """Per task and class one vector: in how many of its rows each bucket occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, settings.buckets), np.int64)
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, end, data, offsets in text_slices(batch.column(1)):
                rows, bucket, _ = _distinct(*terms_of(data, offsets, settings.buckets, settings.prefixes), settings.buckets)
                np.add.at(counts, (toxic[first:end][rows], bucket), 1)
        blocks = counts.reshape(2, -1, min(BLOCK, settings.buckets))
        for kind in range(2):
            used = np.flatnonzero(blocks[kind].any(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), kind, np.int32)), pa.array(used.astype(np.int32)), pa.array([blocks[kind, b].tobytes() for b in used], pa.binary())],
                names=["toxic", "block", "counts"],
            )

    return run


def _adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the vectors of each class and block; one vector of each is held."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for kind, block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            own = np.frombuffer(counts.as_buffer(), np.int64)
            sums[kind, block] = sums[kind, block] + own if (kind, block) in sums else own.copy()
    yield pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in sums], pa.int32()), pa.array([b for _, b in sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
        names=["toxic", "block", "counts"],
    )


def telling(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int, z: float) -> np.ndarray:
    """Buckets whose rows are toxic more often than all rows by ``z`` deviations."""
    share = n_toxic / max(n_clean + n_toxic, 1)
    expected = (clean + toxic) * share
    return np.flatnonzero(toxic - expected >= z * np.sqrt(expected * (1 - share) + 0.25))


def machine_logits(
    rows: np.ndarray, terms: np.ndarray, x: np.ndarray, n: int, bias: float, weights: np.ndarray, vectors: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of ``n`` rows and the sums of their vectors; pairs cost one pass by ((sum v x)^2 - sum (v x)^2) / 2."""
    sums = np.column_stack([np.zeros(n), *[np.bincount(rows, vectors[terms, f] * x, minlength=n) for f in range(vectors.shape[1])]])[:, 1:]
    squares = np.bincount(rows, (vectors ** 2).sum(1)[terms] * x ** 2, minlength=n)
    return bias + np.bincount(rows, weights[terms] * x, minlength=n) + ((sums ** 2).sum(1) - squares) / 2, sums


def fit_machine(
    rows: np.ndarray, terms: np.ndarray, x: np.ndarray, toxic: np.ndarray, n_terms: int, settings: MachineSettings,
) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors that minimise the log loss plus ``shrink`` times their squares (Adam over all rows)."""
    n, factors = len(toxic), settings.factors
    share = min(max(toxic.mean(), 0.5 / n), 1 - 0.5 / n)
    held = np.zeros(1 + n_terms * (1 + factors))
    held[0] = np.log(share / (1 - share))
    held[1 + n_terms:] = np.random.default_rng(13).normal(0, 0.05, n_terms * factors)
    first, second = np.zeros_like(held), np.zeros_like(held)
    weight = np.where(toxic > 0, settings.toxic, 1.0)
    for step in range(1, settings.steps + 1):
        weights, vectors = held[1:1 + n_terms], held[1 + n_terms:].reshape(n_terms, factors)
        logit, sums = machine_logits(rows, terms, x, n, held[0], weights, vectors)
        error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - toxic) * weight / n
        own = error[rows] * x
        pull, square = np.bincount(terms, own, minlength=n_terms), np.bincount(terms, own * x, minlength=n_terms)
        pairs = np.column_stack([np.zeros(n_terms), *[np.bincount(terms, own * sums[rows, f], minlength=n_terms) for f in range(factors)]])[:, 1:]
        slope = np.concatenate([[error.sum()], pull, (pairs - square[:, None] * vectors).ravel()])
        slope[1:] += 2 * settings.shrink * held[1:]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope ** 2
        held = held - settings.rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return float(held[0]), held[1:1 + n_terms].copy(), held[1 + n_terms:].reshape(n_terms, factors).copy()


def learn_machine(labelled: DataFrame, settings: MachineSettings) -> Machine:
    """``labelled`` holds ``toxic`` (boolean) and ``text`` of at most ``settings.sample`` rows."""
    none = Machine(np.full(settings.buckets, -1, np.int32), 0.0, np.zeros(0), np.zeros((0, settings.factors)))
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if not sizes:
        return none
    schema = "toxic int, block int, counts binary"
    counts = np.zeros((2, settings.buckets // min(BLOCK, settings.buckets), min(BLOCK, settings.buckets)), np.int64)
    vectors = labelled.select("toxic", "text").mapInArrow(_counting(settings), schema).repartition("toxic", "block").mapInArrow(_adding, schema)
    for row in vectors.collect():  # one vector of fixed length a class
        counts[row["toxic"], row["block"]] = np.frombuffer(row["counts"], np.int64)
    chosen = telling(counts[0].ravel(), counts[1].ravel(), sizes.get(False, 0), sizes.get(True, 0), settings.z)
    place = np.full(settings.buckets, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(1)):
                rows, bucket = terms_of(data, offsets, settings.buckets, settings.prefixes)
                known = place[bucket] >= 0
                rows, term, x = _distinct(rows[known], place[bucket[known]].astype(np.int64), max(len(chosen), 1))
                cuts = np.searchsorted(rows, np.arange(end - first + 1)).tolist()
                terms, values = ([v[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])] for v in (term.astype(np.int32), x))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(terms, pa.binary()), pa.array(values, pa.binary())], names=["toxic", "terms", "x"],
                )

    # at most settings.sample rows, each with its learned terms only
    # put in an order of their own, as sums of floats depend on it
    found = sorted(tuple(r.values()) for r in labelled.select("toxic", "text").mapInArrow(learned, "toxic boolean, terms binary, x binary").toArrow().to_pylist())
    rows = np.repeat(np.arange(len(found)), [len(terms) // 4 for _, terms, _ in found])
    terms, x = np.frombuffer(b"".join(r[1] for r in found), np.int32), np.frombuffer(b"".join(r[2] for r in found))
    return Machine(place, *fit_machine(rows, terms, x, np.array([r[0] for r in found], float), len(chosen), settings))


def _scoring(broadcast, settings: MachineSettings):
    place, bias, weights, vectors = broadcast.value

    def kernel(batch, first, end, data, offsets):
        n = end - first
        rows, bucket = terms_of(data, offsets, settings.buckets, settings.prefixes)
        term = place[bucket]
        known = term >= 0
        rows, term, x = _distinct(rows[known], term[known].astype(np.int64), max(len(weights), 1))
        logit, _ = machine_logits(rows, term, x, n, bias, weights, vectors)
        return {"score": 1 / (1 + np.exp(-np.clip(logit, -40, 40)))}

    return kernel


def score_toxicity(
    docs: DataFrame, labels: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text", settings: MachineSettings = MachineSettings(),
) -> DataFrame:
    """The id and ``score``, the probability (0 to 1) that a document is toxic, of every row of ``docs``.

    ``labels`` holds the id and ``toxic`` (0/1); ``learned`` is a condition on its id column. Of the
    labelled rows for which it holds, at most ``settings.sample``, drawn by the hash of the id, are
    learned from: counts over them tell which buckets of hashed terms go with a label, and a
    factorization machine over the presence of these gets a weight for each term and, by the product
    of their vectors, one for each pair that occurs together. A text is scored as a whole, from its terms alone.

    NULL and empty texts have no terms and get the machine's bias; so has every text without learned
    terms. A NULL id or label is not learned from; repeated labels of an id are one, toxic if any is;
    repeated rows of ``docs`` are scored each, of those with one id the least text is learned from. Without labels all scores are one half.
    An empty table gives no rows; other columns are left aside.
    """
    truth = (
        labels.filter(F.coalesce(learned, F.lit(False)) & F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg((F.max("toxic") == 1).alias("toxic"))
    )
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    drawn = truth.withColumn("_hash", F.xxhash64("_id", F.lit(settings.seed))).orderBy("_hash", "_id").limit(settings.sample)
    drawn = staged(drawn.select("_id", "toxic"), "toxic-labels")
    rows = chosen.join(F.broadcast(drawn), F.col("id") == F.col("_id"))  # at most settings.sample ids
    labelled = staged(rows.groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).drop("id"), "toxic-sample")
    machine = learn_machine(labelled, settings)
    # plain arrays, so that workers need no class of this package
    shipped = docs.sparkSession.sparkContext.broadcast((machine.place, machine.bias, machine.weights, machine.vectors))
    added = T.StructType([T.StructField("score", T.DoubleType())])
    return map_texts(chosen, "text", ["id"], added, lambda: _scoring(shipped, settings)).withColumnRenamed("id", id_col)


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    scored = score_toxicity(docs, labels, remainder != 2)
    return scored.select(
        "doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )
