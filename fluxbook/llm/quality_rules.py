"""Operator 7: quality rules, with an isolation forest on the rules' statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fluxbook.llm.staging import running_totals, staged
from fluxbook.llm.texts import BASE, IS_SPACE, map_texts, mix, per_row, span_hashes, U64, windows, words_of

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Characters of a usual word, with the marks behind it.
USUAL_CHARS = 5.5
MARK_WEIGHT = 0.2
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
IS_UPPER = np.zeros(256, bool)
IS_UPPER[65:91] = True
IS_MARK = np.zeros(256, bool)
IS_MARK[list(b"!?;:()[]{}=_/\\@^~+\"'`0123456789")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_kinds", "n_lines")
N_FEATURES = 5
LOW, HIGH = [f"low{f}" for f in range(N_FEATURES)], [f"high{f}" for f in range(N_FEATURES)]
#: Rows, least and greatest features of nodes of the forest.
Ranges = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class ForestSettings:
    """``trees``: of the forest; all rows are dealt out to them, at least ``rows_per_tree`` to each. That number also bounds
    the depth, so the forest's size does not follow the table's. ``good_cost``: how many rejected bad rows make up for one
    rejected good one."""

    trees: int = 100
    rows_per_tree: int = 256
    good_cost: float = 40.0
    seed: int = 7


def _repeats(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs at least twice."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _statistics():
    def kernel(batch, first, end, data, offsets):
        n = len(offsets) - 1
        starts, ends, rows = words_of(data, offsets)
        solid = ~IS_SPACE[data]
        hashes = span_hashes(data, starts, ends)
        salt = mix(rows.astype(U64) + U64(1))
        # lines: from a row's start or a line feed to the next one or the row's end
        feeds = np.flatnonzero(data == 10)
        line_starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
        line_rows = np.repeat(np.arange(n), per_row(data == 10, offsets) + 1)
        line_ends = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
        seen = np.zeros(len(data) + 1, np.int64)
        np.cumsum(solid, out=seen[1:])
        full = seen[line_ends] > seen[line_starts]
        line_starts, line_ends, line_rows = line_starts[full], line_ends[full], line_rows[full]
        line_keys = mix(line_rows.astype(U64) + U64(1)) ^ span_hashes(data, line_starts, line_ends)
        _, kept = np.unique(line_keys, return_index=True)
        lines = np.bincount(line_rows, minlength=n)
        # words in repeated windows
        keys, at = windows(hashes, rows, WINDOW)
        twice = at[_repeats(keys ^ salt[at])]
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + WINDOW, -1)
        covered = np.cumsum(cover[:-1]) > 0
        n_words = np.bincount(rows, minlength=n)
        _, different = np.unique(hashes ^ salt, return_index=True)
        return {
            "n_words": n_words,
            "word_chars": per_row(solid & ((data & 0xC0) != 0x80), offsets),
            "n_symbols": per_row(IS_SYMBOL[data], offsets),
            "n_dup_lines": lines - np.bincount(line_rows[kept], minlength=n),
            "n_repeat_words": np.bincount(rows[covered], minlength=n),
            "n_upper": per_row(IS_UPPER[data], offsets),
            "n_marks": per_row(IS_MARK[data], offsets),
            "n_kinds": np.bincount(rows[different], minlength=n),
            "n_lines": lines,
        }

    return kernel


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the counts of the rules for every document."""
    return map_texts(docs, text_col, [id_col], T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]), _statistics)


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios in which rules are stated: symbols and, with less weight, other marks; repeated windows or lines; capitals; repeated
    words; how far the length of words is from the usual one, in octaves. All 0 without words."""
    words = np.maximum(counts["n_words"], 1).astype(float)
    chars = np.maximum(counts["word_chars"], 1).astype(float)
    return np.column_stack([
        (counts["n_symbols"] + MARK_WEIGHT * counts["n_marks"]) / words,
        np.maximum(counts["n_repeat_words"] / words, counts["n_dup_lines"] / np.maximum(counts["n_lines"], 1)),
        counts["n_upper"] / chars,
        (counts["n_words"] - counts["n_kinds"]) / words / np.log2(words + 1),
        np.where(counts["n_words"] > 0, np.abs(np.log2(chars / words / USUAL_CHARS)), 0.0),
    ])


def parts_of(n: int, settings: ForestSettings) -> int:
    """How many trees share the ``n`` rows; the more rows, the more trees, up to all."""
    return min(max(n // settings.rows_per_tree, 1), settings.trees)


def dealt(hashes: np.ndarray, parts: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows and the trees they go to. Each round deals all rows out to the next ``parts`` trees."""
    rounds = np.repeat(np.arange(-(-trees // parts)), len(hashes))
    rows = np.tile(np.arange(len(hashes)), -(-trees // parts))
    to = rounds * parts + (mix(hashes[rows] + (rounds + 1).astype(U64) * BASE) % U64(parts)).astype(np.int64)
    return rows[to < trees], to[to < trees]


def descend(feature: np.ndarray, split: np.ndarray, left: np.ndarray, points: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The node without a split that each point comes to from its ``node``."""
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return node
        right = points[np.arange(len(points)), np.maximum(f, 0)] >= split[node]
        node = np.where(inner, left[node] + right, node)


def ranges_of(nodes: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> Ranges:
    """One line for each of ``size`` nodes from any number of lines a node; without any, no rows."""
    order = np.argsort(nodes, kind="stable")
    own, first = np.unique(nodes[order], return_index=True)
    out = np.zeros(size, np.int64), np.full((size, low.shape[1]), np.inf), np.full((size, low.shape[1]), -np.inf)
    if len(own):
        for to, values, join in zip(out, (counts, low, high), (np.add, np.minimum, np.maximum)):
            to[own] = join.reduceat(values[order], first)
    return out


def grow(measure: Callable[..., Ranges], n: int, settings: ForestSettings) -> list[tuple[np.ndarray, ...]]:
    """Isolation trees as arrays: feature (-1 for a leaf), split, left child, path length at a leaf.

    They grow by levels. ``measure`` gets the trees so far as arrays of one another, the root of each and, for each node,
    its place among those of the newest level or -1; it gives the ranges of that level over all rows.
    """
    rng = np.random.default_rng(settings.seed)
    limit = int(np.ceil(np.log2(max(min(settings.rows_per_tree, n), 2))))
    forest = [([-1], [0.0], [0], [0.0]) for _ in range(settings.trees)]
    newest = [(t, 0) for t in range(settings.trees)]
    for depth in range(limit + 1):
        roots = np.cumsum([0] + [len(tree[0]) for tree in forest])
        place = np.full(roots[-1], -1)
        place[[roots[t] + node for t, node in newest]] = np.arange(len(newest))
        feature, split = (np.concatenate([tree[i] for tree in forest]) for i in (0, 1))
        left = np.concatenate([np.array(tree[2]) + root for tree, root in zip(forest, roots)])
        counts, low, high = measure(feature, split, left, roots[:-1], place, len(newest))
        level, newest = newest, []
        for i, (t, node) in enumerate(level):
            feature, split, left, length = forest[t]
            # a split next to the least value may leave nothing on one side
            open_to = np.flatnonzero(high[i] > low[i])
            if depth >= limit or counts[i] <= 1 or not len(open_to):
                length[node] = depth + average_path(int(counts[i]))
                continue
            feature[node] = f = int(rng.choice(open_to))
            split[node] = float(rng.uniform(low[i, f], high[i, f]))
            left[node] = len(feature)
            for child in range(2):
                newest.append((t, len(feature)))
                feature.append(-1), split.append(0.0), left.append(0), length.append(0.0)
        if not newest:
            break
    return [tuple(np.array(column) for column in tree) for tree in forest]


def _level(points: np.ndarray, hashes: np.ndarray, parts: int, feature, split, left, roots, place, size) -> Ranges:
    rows, trees = dealt(hashes, parts, len(roots))
    own = points[rows]
    nodes = place[descend(feature, split, left, own, roots[trees])]
    held = nodes >= 0
    return ranges_of(nodes[held], np.ones(held.sum(), np.int64), own[held], own[held], size)


def grow_forest(points: np.ndarray, settings: ForestSettings, hashes: np.ndarray | None = None) -> list[tuple[np.ndarray, ...]]:
    """The forest of an array; rows are dealt out by ``hashes``, else by their places."""
    hashes = np.arange(len(points)).astype(U64) if hashes is None else hashes
    parts = parts_of(len(points), settings)
    return grow(lambda *level: _level(points, hashes, parts, *level), len(points), settings)


def row_hash(id_col: str, settings: ForestSettings) -> Column:
    return F.xxhash64(id_col, *COUNTS, F.lit(settings.seed))


def grow_forest_on(statistics: DataFrame, n: int, id_col: str, settings: ForestSettings) -> list[tuple[np.ndarray, ...]]:
    """The forest of all ``n`` rows of a table. Each level is one pass in which tasks sum up their own rows by node; only the
    ranges of a level's nodes come to the driver."""
    rows = statistics.select(*COUNTS, row_hash(id_col, settings).alias("_hash"))
    parts = parts_of(n, settings)
    schema = ", ".join(["node int", "n long"] + [f"{c} double" for c in LOW + HIGH])

    def measure(*level) -> Ranges:
        size = level[-1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, low, high = np.zeros(size, np.int64), np.full((size, N_FEATURES), np.inf), np.full((size, N_FEATURES), -np.inf)
            for batch in batches:
                *own, hashes = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
                more, least, most = _level(features(dict(zip(COUNTS, own))), hashes.view(U64), parts, *level)
                counts, low, high = counts + more, np.minimum(low, least), np.maximum(high, most)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array(counts[used])] + [pa.array(side[used, f]) for side in (low, high) for f in range(N_FEATURES)],
                names=["node", "n", *LOW, *HIGH],
            )

        sums = [F.sum("n").alias("n")] + [F.min(c).alias(c) for c in LOW] + [F.max(c).alias(c) for c in HIGH]
        found = rows.mapInArrow(run, schema).groupBy("node").agg(*sums).toArrow()  # one row a node of the level
        node, counts, *sides = (found.column(c).to_numpy() for c in ("node", "n", *LOW, *HIGH))
        return ranges_of(node, counts, np.column_stack(sides[:N_FEATURES]), np.column_stack(sides[N_FEATURES:]), size)

    return grow(measure, n, settings)


def average_path(n: int) -> float:
    """Mean path of an unsuccessful search among ``n`` rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def anomaly(forest: list[tuple[np.ndarray, ...]], points: np.ndarray, rows_per_tree: int) -> np.ndarray:
    """Score from 0 to 1; the shorter the mean path, the higher."""
    paths = np.zeros(len(points))
    for feature, split, left, length in forest:
        node = descend(feature, split, left, points, np.zeros(len(points), np.int64))
        paths += length[node]
    return 2.0 ** -(paths / len(forest) / max(average_path(rows_per_tree), 1e-9))


def _scorer(forest: list[tuple[np.ndarray, ...]], size: int) -> Column:
    @F.pandas_udf("double")
    def scored(counts: pd.DataFrame) -> pd.Series:
        return pd.Series(anomaly(forest, features({c: counts[c].to_numpy() for c in COUNTS}), size))

    return scored(F.struct(*COUNTS))


def best_limit(scores: DataFrame, settings: ForestSettings) -> float:
    """The score from which on rejecting gains most, over all rows of ``score`` and ``_good``; infinite where no limit gains."""
    by_score = staged(
        scores.groupBy("score").agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad")), "rules-scores"
    )
    all_good, all_bad = by_score.agg(F.sum("good"), F.sum("bad")).first()
    above = running_totals(by_score, [], [F.desc("score")], {"good": "good_above", "bad": "bad_above"}, "rules-limit")
    gain = (F.col("bad_above") + F.col("bad")) / F.lit(float(max(all_bad, 1))) - settings.good_cost * (F.col("good_above") + F.col("good")) / F.lit(float(all_good))
    best = above.select(gain.alias("gain"), "score").agg(F.max(F.struct("gain", "score")).alias("best")).first()["best"]
    return float(best["score"]) if best["gain"] > 0 else np.inf


def fit(statistics: DataFrame, labels: DataFrame, id_col: str, settings: ForestSettings):
    """A forest on all rows with enough words and the threshold that separates all labelled ones best, or None without labels."""
    rated = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
    truth = rated.groupBy(F.col(id_col).alias("_id")).agg((F.min("quality") == 1).alias("_good"))
    judged = statistics.filter(F.col("n_words") >= LEAST_WORDS)
    labelled = staged(judged.join(truth, F.col(id_col) == F.col("_id")).select(*COUNTS, "_good"), "rules-labelled")
    if labelled.filter("_good").count() < 2:
        return None
    n = judged.count()
    forest = grow_forest_on(judged, n, id_col, settings)
    size = -(-n // parts_of(n, settings))
    return forest, best_limit(labelled.select(_scorer(forest, size).alias("score"), "_good"), settings), size


def judge_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: ForestSettings = ForestSettings(),
) -> DataFrame:
    """The id, the rules' counts, ``base_failed``, ``anomaly`` and ``kept`` for every document.

    A document fails the base rules with fewer than 20 words or with more than 30 % of them in
    repeated windows of eight; else the forest decides. It is grown on all documents with 20 words or
    more, and its threshold comes from all of these that are labelled. NULL and empty texts have no words and
    fail. Repeated rows are judged each, NULL ids too; of several labels of one id the lowest counts. Without labels of good rows the forest
    keeps all; an empty table gives no rows. Other columns are left aside.
    """
    statistics = staged(rule_statistics(docs, id_col, text_col), "rules")
    model = fit(statistics, labels, id_col, settings)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = statistics.withColumn("base_failed", failed)
    if model is None:
        return judged.withColumns({"anomaly": F.lit(0.0), "kept": ~F.col("base_failed")})
    forest, limit, size = model
    scores = judged.withColumn("anomaly", _scorer(forest, size))
    return scores.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < limit))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge_quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
