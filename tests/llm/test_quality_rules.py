"""Operator 7: rule statistics against plain loops, and the forest on planted anomalies."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fluxbook.llm.quality_rules import COUNTS, ForestSettings, anomaly, average_path, dealt, features, fit, grow_forest, judge_quality, parts_of, rule_statistics


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = [tuple(words[i:i + 8]) for i in range(n - 7)]
    times = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    failed = n < 20 or 100 * len(repeated) > 30 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(repeated), failed


def test_statistics(frame, documents, corpus):
    rng = random.Random(2)
    few = [" ".join(rng.choice(["a", "b#", "ç", "d\n", "d\n", "\t"]) for _ in range(rng.randint(1, 120))) for _ in range(80)]
    few += ["x y z\nx y z\n\n\n x y z\nx y z", "same line here\r\nsame line here\n", " ".join(["one two three four five six seven eight"] * 3), "q " * 19, "q r s t u " * 4]
    extra = frame([(1000 + i, t) for i, t in enumerate(few)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(extra)
    labels = frame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    found = sorted([tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in judge_quality(docs, labels).collect()], key=str)
    assert found == sorted([(i, *brute(t)) for i, t in [(r[0], r[1]) for r in corpus] + [(1000 + i, t) for i, t in enumerate(few)]], key=str)


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(0, 1, (500, 3)), [[9.0, 9, 9], [-8, 8, 8]]])
    score = anomaly(grow_forest(points, ForestSettings()), points, min(ForestSettings().rows_per_tree, len(points)))
    assert set(np.argsort(-score)[:2]) == {500, 501}
    assert ((score > 0) & (score < 1)).all()


def test_verdict(frame, no_documents):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(600):  # anomalies are rare: one text of 25
        bad = i % 25 == 0
        rows.append((i, " ".join((rng.choice("#|<>$") * 3 if bad and rng.random() < 0.7 else word()) for _ in range(60))))
        if i % 2:
            labels.append((i, 0 if bad else 1, 0))
    docs, truth = frame(rows, "doc_id long, text string"), frame(labels, "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in judge_quality(docs, truth).collect()}
    good, bad = [kept[i] for i, _ in rows if i % 25], [kept[i] for i, _ in rows if i % 25 == 0]
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.2 * len(bad)
    assert all(r["kept"] != r["base_failed"] for r in judge_quality(docs, truth.limit(0)).collect())
    assert judge_quality(no_documents, truth).collect() == []


def path_by_loops(tree, point):
    feature, split, left, length = tree
    node = 0
    while feature[node] >= 0:
        node = left[node] + (point[feature[node]] >= split[node])
    return length[node]


def test_verdict_by_loops(frame):
    """The verdict is the mean path through every tree against the threshold; repeated and contradicting labels change nothing."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        lines = [" ".join(rng.choices(["ab", "cde", "fghi", "jk"], k=6)) for _ in range(8)]
        if i % 10 == 0:
            lines = [lines[0] + str(k % 2) for k in range(8)]
        if i % 10 == 1:
            lines = [line.replace("a", "a" * 40) for line in lines]
        rows.append((i, "\n".join(lines)))
    docs = frame(rows, "doc_id long, text string")
    labels = [(i, int(i % 10 > 1), 0) for i in range(0, 300, 2)] + [(i, int(i % 10 > 1), 0) for i in range(1, 300, 2)]
    schema = "doc_id long, quality int, toxic int"
    settings = ForestSettings(trees=20)
    judged = {r["doc_id"]: r for r in judge_quality(docs, frame(labels, schema), settings=settings).collect()}
    statistics = rule_statistics(docs)
    forest, limit, size = fit(statistics, frame(labels, schema), "doc_id", settings)
    for r in statistics.collect():
        counts = {c: np.array([r[c]]) for c in statistics.columns if c != "doc_id"}
        point = features(counts)[0]
        score = 2 ** -(np.mean([path_by_loops(t, point) for t in forest]) / average_path(size))
        own = judged[r["doc_id"]]
        assert abs(own["anomaly"] - score) < 1e-9 and own["kept"] == (not own["base_failed"] and own["anomaly"] < limit)
    bad = [i for i in judged if i % 10 <= 1]
    assert sum(not judged[i]["kept"] for i in bad) >= 0.8 * len(bad)
    assert sum(not r["kept"] for i, r in judged.items() if i % 10 > 1) <= 0.05 * len(judged)
    again = labels * 3 + [(i, 1, 0) for i in bad] + [(None, 0, 0), (5, None, 0)]
    assert {i: r["kept"] for i, r in judged.items()} == {r["doc_id"]: r["kept"] for r in judge_quality(docs, frame(again, schema), settings=settings).collect()}


def counted(spark, n):
    """Statistics of ``n`` rows and labels of all but each third; every 40th row is bad, and a few good ones look like it."""
    draw = lambda k, most: f"pmod(xxhash64(id, {k}), {most})"
    rows = spark.range(n).selectExpr("id AS doc_id", f"20 + {draw(1, 300)} AS n_words", f"CAST(id % 40 = 0 AS int) * 4 + CAST({draw(2, 2000)} = 0 AS int) AS odd")
    statistics = rows.withColumnRenamed("doc_id", "id").selectExpr(
        "id AS doc_id", "n_words", f"n_words * 5 + {draw(3, 60)} AS word_chars", f"{draw(4, 6)} + odd * {draw(5, 90)} AS n_symbols", f"{draw(6, 2)} AS n_dup_lines",
        "0L AS n_repeat_words", f"{draw(7, 30)} AS n_upper", f"{draw(8, 30)} + odd * {draw(9, 200)} AS n_marks", f"n_words - {draw(10, 20)} AS n_kinds", "12L AS n_lines",
    )
    return statistics, rows.filter("doc_id % 3 > 0").selectExpr("doc_id", "CAST(doc_id % 40 > 0 AS int) AS quality")


def test_all_rows_are_learned_from(spark):
    """No row is left out: more rows than any sample, and forest and threshold are those of all of them."""
    statistics, labels = counted(spark, 36_000)
    settings = ForestSettings(trees=30)
    forest, limit, size = fit(statistics.repartition(5), labels, "doc_id", settings)
    rows = statistics.join(labels, "doc_id", "left").toPandas()
    points = features({c: rows[c].to_numpy() for c in rows})
    # the threshold: over all labelled rows, each score as a limit
    score, quality = anomaly(forest, points, size), rows["quality"].to_numpy()
    limits, where = np.unique(score, return_inverse=True)
    good, bad = (np.bincount(where, quality == q, len(limits))[::-1].cumsum()[::-1] for q in (1, 0))
    gain = bad / bad[0] - settings.good_cost * good / good[0]
    assert good[0] + bad[0] == 24_000 and gain.max() > 0 and limit == limits[np.flatnonzero(gain == gain.max())[-1]]
    # the trees: the rows of each, dealt once a round, are in its leaves and on both sides of its splits
    hashes = statistics.select("doc_id", F.xxhash64("doc_id", *COUNTS, F.lit(settings.seed)).alias("h")).toPandas().set_index("doc_id")["h"]
    places, trees = dealt(hashes.loc[rows["doc_id"]].to_numpy().view(np.uint64), parts_of(len(rows), settings), settings.trees)
    assert sorted(places) == list(range(len(rows))) and set(trees) == set(range(settings.trees))
    for t, (feature, split, left, length) in enumerate(forest):
        inside = {0: (points[places[trees == t]], 0)}
        for node in range(len(feature)):
            own, depth = inside[node]
            if feature[node] < 0:
                assert length[node] == depth + average_path(len(own))
            else:
                column = own[:, feature[node]]
                assert column.min() <= split[node] <= column.max()
                for side in range(2):
                    inside[left[node] + side] = (own[(column >= split[node]) == side], depth + 1)
    alike = grow_forest(points, settings, hashes.loc[rows["doc_id"]].to_numpy().view(np.uint64))
    assert all(np.array_equal(a, b) for one, two in zip(forest, alike) for a, b in zip(one, two))


def test_few_rows_go_to_every_tree(spark):
    statistics, labels = counted(spark, 200)
    forest, limit, size = fit(statistics, labels, "doc_id", ForestSettings(trees=5))
    assert size == 200 and len(forest) == 5
    assert fit(statistics, labels.filter("quality = 0"), "doc_id", ForestSettings(trees=5)) is None
    assert fit(statistics.limit(0), labels, "doc_id", ForestSettings(trees=5)) is None
