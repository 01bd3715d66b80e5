"""Operator 9: a quality classifier by importance resampling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fluxbook.llm.staging import running_totals, staged, text_hash
from fluxbook.llm.texts import LOWERED, U64, map_texts, span_hashes, text_slices, windows, words_of

#: Word n-grams of one and two words; of words longer than that also the first 4 and 5 bytes, which inflected forms share.
STEMS = (4, 5)
FAMILIES = 2 + len(STEMS)
BLOCK = 1 << 12


@dataclass(frozen=True)
class ResamplingSettings:
    """``buckets``: hash buckets of each family of n-grams (a power of two). ``sample``: labelled
    rows used at most, half for the target's counts, half for the cut, by the hashes of their ids.
    ``added``: smoothing count. ``z``: a bucket speaks against a text only where the target falls
    short of the raw text by so many standard errors. ``shrink``: added length, which keeps the
    means of short texts near 0. ``good_cost``: how many rejected bad rows make up for one
    rejected good one. ``temperature``: scale of the Gumbel noise."""

    buckets: int = 1 << 18
    sample: int = 40_000
    added: float = 1.0
    z: float = 3.0
    shrink: float = 60.0
    good_cost: float = 5.0
    temperature: float = 0.1
    seed: int = 9


def _features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram."""
    starts, ends, rows = words_of(data, offsets)
    hashes = span_hashes(data, starts, ends, LOWERED)
    pairs, at = windows(hashes, rows, 2)
    families = [(rows, hashes), (rows[at], pairs)]
    for n in STEMS:
        long = ends - starts > n
        families.append((rows[long], span_hashes(data, starts[long], starts[long] + n, LOWERED)))
    mask = U64(buckets - 1)
    return np.concatenate([r for r, _ in families]), np.concatenate([(h & mask).astype(np.int64) + i * buckets for i, (_, h) in enumerate(families)])


def _counting(buckets: int):
    """Per task the counts of all texts (model 0) and of the target's (model 1), in blocks of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, FAMILIES * buckets), np.int64)
        for batch in batches:
            target_all = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for first, end, data, offsets in text_slices(batch.column(1)):
                rows, bucket = _features(data, offsets, buckets)
                np.add.at(counts[0], bucket, 1)
                np.add.at(counts[1], bucket[target_all[first:end][rows]], 1)
        blocks = counts.reshape(2, -1, BLOCK)
        for model in range(2):
            used = np.flatnonzero(blocks[model].any(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), model, np.int32)), pa.array(used.astype(np.int32)), pa.array([blocks[model, b].tobytes() for b in used], pa.binary())],
                names=["model", "block", "counts"],
            )

    return run


def _summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the count blocks of a partition, which has all rows of its blocks; one vector a block is held."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for model, block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            own = np.frombuffer(counts.as_buffer(), np.int64)
            if (model, block) in sums:
                sums[model, block] += own
            else:
                sums[model, block] = own.copy()
    yield pa.RecordBatch.from_arrays(
        [pa.array([m for m, _ in sums], pa.int32()), pa.array([b for _, b in sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
        names=["model", "block", "counts"],
    )


def log_ratios(raw: np.ndarray, target: np.ndarray, settings: ResamplingSettings) -> np.ndarray:
    """log(target / raw) of each bucket where the target falls short for sure, else 0."""
    expected = raw * (target.sum() / max(raw.sum(), 1))
    short = (target - expected) / np.sqrt(expected + 1) < -settings.z
    return np.where(short, np.log((target + settings.added) / (expected + settings.added)), 0.0).astype(np.float32)


def _cut(weight: np.ndarray, good: np.ndarray, cost: float) -> float:
    """The mean weight below which labelled bad rows outweigh good ones most."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weight, kind="stable")
    gain = np.concatenate([[0.0], np.cumsum(np.where(good[order], -cost / good.sum(), 1.0 / (~good).sum()))])
    edges = np.concatenate([[True], weight[order][1:] != weight[order][:-1], [True]])
    best = int(np.argmax(np.where(edges, gain, -np.inf)))
    if best == 0:
        return -np.inf
    return float((weight[order][best - 1] + weight[order][min(best, len(order) - 1)]) / 2)


def resample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: ResamplingSettings = ResamplingSettings(),
) -> DataFrame:
    """The id, ``text_hash``, ``n_grams``, ``log_weight``, ``key`` and ``kept`` of every document.

    Two hashed n-gram models are counted: one of the target, labelled documents of quality 1
    that are not toxic (a bounded sample), one of all raw text. A document's mean log ratio of
    the two, less the cut that separates held-back labelled rows best, times its length is its
    log importance weight; Gumbel noise by the hash of its id is added, and the k documents with
    the highest keys are drawn, k being the number of documents that the weights favour.

    NULL and empty texts have no n-grams and a mean of 0; NULL ids share a noise. Without good
    and bad labels all documents are kept. Repeated rows are rows of their own; of equal keys
    the smaller id goes first. An empty table gives no rows; other columns are left aside.
    """
    spark = docs.sparkSession
    truth = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        ((F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("_good")
    )
    hashed = truth.withColumn("_hash", F.xxhash64("_id", F.lit(settings.seed)))
    sample = staged(hashed.orderBy("_hash", "_id").limit(settings.sample), "resample-labels").withColumn("_fit", F.pmod("_hash", F.lit(2)) == 0)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_hash(text_col).alias("text_hash"))
    fitted = F.broadcast(sample.filter("_fit and _good").select("_id"))  # at most settings.sample rows
    marked = chosen.join(fitted, F.col("id") == F.col("_id"), "left").select(F.col("_id").isNotNull().alias("target"), "text")
    schema = "model int, block int, counts binary"
    vectors = marked.mapInArrow(_counting(settings.buckets), schema).repartition("model", "block").mapInArrow(_summing, schema).collect()
    models = np.zeros((2, FAMILIES * settings.buckets // BLOCK, BLOCK))
    for row in vectors:
        models[row["model"], row["block"]] = np.frombuffer(row["counts"], np.int64)
    ratios = spark.sparkContext.broadcast(log_ratios(models[0].ravel(), models[1].ravel(), settings))

    def weighing():
        table = ratios.value

        def kernel(batch, first, end, data, offsets):
            rows, bucket = _features(data, offsets, settings.buckets)
            n = np.bincount(rows, minlength=end - first)
            return {"n_grams": n, "mean": np.bincount(rows, table[bucket], minlength=end - first) / (n + settings.shrink)}

        return kernel

    added = T.StructType([T.StructField("n_grams", T.LongType()), T.StructField("mean", T.DoubleType())])
    weighed = staged(map_texts(chosen, "text", ["id", "text_hash"], added, weighing), "resample-weights")
    held = weighed.join(F.broadcast(sample.filter("not _fit").select("_id", "_good")), F.col("id") == F.col("_id")).select("mean", "_good").toPandas()
    cut = _cut(held["mean"].to_numpy(float), held["_good"].to_numpy(bool), settings.good_cost)
    if np.isinf(cut):
        return weighed.select(F.col("id").alias(id_col), "text_hash", "n_grams", F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("key"), F.lit(True).alias("kept"))
    uniform = (F.pmod(F.xxhash64("id", F.lit(settings.seed), F.lit("gumbel")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weight = (F.col("mean") - cut) * (F.col("n_grams") + settings.shrink)
    keyed = weighed.withColumn("log_weight", weight).withColumn("key", F.col("log_weight") - settings.temperature * F.log(-F.log(uniform)))
    draws = weighed.filter(F.col("mean") > cut).count()
    ranked = running_totals(keyed.withColumn("one", F.lit(1).cast("long")), [], [F.col("key").desc(), F.col("id").asc_nulls_last()], {"one": "rank"}, "resample-rank")
    return ranked.select(F.col("id").alias(id_col), "text_hash", "n_grams", "log_weight", "key", (F.col("rank") < draws).alias("kept"))


def op9_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).drop("text_hash")
