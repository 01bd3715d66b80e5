"""Operator 12: how far the sources of a language diverge in their terms, from a frequent-pattern tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fluxbook.llm.staging import running_totals, staged
from fluxbook.llm.texts import LOWERED, span_hashes, spans_of, text_slices

SCALE = 1_000_000_000
LEAST_DOCUMENTS = 10
TOP_TERMS = 10
#: Bytes of a term: ASCII letters and all of other characters.
IN_TERM = np.zeros(256, bool)
IN_TERM[65:91] = IN_TERM[97:123] = IN_TERM[128:] = True
SLICE = 8 << 20
#: Pairs of a node and an ancestor that are worked on at once.
PAIRS = 1 << 20
#: Nodes at the beginning of a path that say which range it is in.
RANGED = 6
#: Shares of a language's sources and counts among tasks.
SALTS = 32


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice of texts and language, source and term: occurrences and documents."""
    for batch in batches:
        lang, source = (c.dictionary_encode() for c in batch.columns[:2])
        group = lang.indices.to_numpy().astype(np.int64) * max(len(source.dictionary), 1) + source.indices.to_numpy()
        for first, end, data, offsets in text_slices(batch.column(2), SLICE):
            starts, ends, rows = spans_of(IN_TERM[data], offsets)
            hashes = span_hashes(data, starts, ends, LOWERED)
            order = np.lexsort((rows, hashes, group[first:end][rows]))
            own, hashes, rows = group[first:end][rows[order]], hashes[order], rows[order]
            if not len(order):
                continue
            term_begins = np.append(True, (np.diff(own) != 0) | (hashes[1:] != hashes[:-1]))
            begin = np.flatnonzero(term_begins)
            n = np.diff(np.append(begin, len(order)))
            docs = np.add.reduceat((term_begins | np.append(True, np.diff(rows) != 0)).astype(np.int64), begin)
            example = order[begin]
            small = LOWERED[data].tobytes()
            terms = pa.array([small[a:b] for a, b in zip(starts[example].tolist(), ends[example].tolist())], pa.binary()).cast(pa.string())
            rows_of_group = first + rows[begin]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows_of_group)), batch.column(1).take(pa.array(rows_of_group)), terms, pa.array(n), pa.array(docs)],
                names=["lang", "source", "term", "n", "docs"],
            )


def _share(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kinds)), exact in decimals; 1 where the language keeps no term."""
    above = f"cast({SCALE} as decimal(10,0)) * cast({n} + 2 as decimal(20,0))"
    return F.coalesce(F.expr(f"({above}) div nullif(cast({total} + 2 * kinds as decimal(20,0)), 0)"), F.lit(0)) + 1


def _gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so a long holds the square."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of pairs of sources from paths in order, with how many terms share each.

    Sorted paths pass through the tree from left to right: where a path leaves the one before it,
    new nodes begin, and a node ends with the last path that goes through it. A batch of paths is
    worked on by itself. A node whose paths lie in two batches counts in each by its paths there;
    corrections add up, so its parts make the whole.
    """
    for batch in batches:
        lang, times = batch.column(0).dictionary_encode(), batch.column(2).to_numpy()
        sizes = batch.column(1).value_lengths().to_numpy().astype(np.int64)
        flat = batch.column(1).flatten()
        place, n, p, p0 = (flat.field(i).to_numpy() for i in range(4))
        begins = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        depth = np.arange(len(row)) - begins[row]
        group = lang.indices.to_numpy().astype(np.int64)
        before = np.maximum(row - 1, 0)
        twin = np.minimum(begins[before] + depth, max(len(row) - 1, 0))
        same = (row > 0) & (depth < sizes[before]) & (group[row] == group[before])
        same &= (place == place[twin]) & (n == n[twin])
        shared = sizes.copy()  # symbols that a path shares with the one before it
        np.minimum.at(shared, row[~same], depth[~same])
        upto = np.concatenate([[0], np.cumsum(times)])
        node, weight = [], []
        for level in range(1, int(sizes.max(initial=0))):  # nodes of the first level have no ancestor
            cuts = np.flatnonzero(shared <= level)  # paths that don't go on through the node before them
            after = np.append(cuts[1:], len(sizes))
            through = sizes[cuts] > level
            node.append(begins[cuts[through]] + level)
            weight.append(upto[after[through]] - upto[cuts[through]])
        if not node:
            continue
        node, weight = np.concatenate(node), np.concatenate(weight)
        work = np.cumsum(depth[node])
        cut = 0
        while cut < len(node):
            end = int(max(np.searchsorted(work, (work[cut - 1] if cut else 0) + PAIRS, "right"), cut + 1))
            of, times_of = node[cut:end], weight[cut:end]
            above = depth[of]
            b = np.repeat(of, above)
            first = np.cumsum(above) - above
            a = np.repeat(begins[row[of]] - first, above) + np.arange(len(b))
            value = _gaps(p[a], p[b]) - _gaps(p0[a], p[b]) - _gaps(p[a], p0[b]) + _gaps(p0[a], p0[b])
            value *= np.repeat(times_of, above)
            order = np.lexsort((place[b], place[a], group[row[b]]))
            a, b, value = a[order], b[order], value[order]
            g, x, y = group[row[b]], place[a], place[b]
            at = np.flatnonzero(np.append(True, (np.diff(g) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)))
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(g[at])), pa.array(x[at]), pa.array(y[at]), pa.array(np.add.reduceat(value, at))], names=["lang", "a", "b", "value"]
            )
            cut = end


def _counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str, least: int) -> tuple[DataFrame, DataFrame]:
    """``groups``: lang, source, its ``place`` in the language's order, ``total``, ``lang_total``, ``kinds`` and ``p0``, the share of a
    term that it lacks. ``counts``: of each kept term and group that has it, the count ``n``, the shares ``p`` and ``q``, the language's."""
    chosen = docs.select(
        F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(text_col).alias("text")
    )
    found = chosen.mapInArrow(_counting, "lang string, source string, term string, n long, docs long")
    by_source = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = staged(
        by_source.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_all"), F.collect_list(F.struct("source", "n")).alias("counts"))
        .filter(F.col("docs") >= least).drop("docs"),
        "audit-terms",
    )
    single = terms.select("lang", "term", "n_all", F.explode("counts").alias("c")).select("lang", "term", "n_all", "c.source", "c.n")
    kinds = terms.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("n_all").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    known = staged(
        chosen.select("lang", "source").distinct()
        .join(single.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(kinds, "lang", "left")
        .select("lang", "source", zero("total"), zero("lang_total"), zero("kinds"), F.lit(1).cast("long").alias("one")),
        "audit-groups",
    )
    groups = staged(
        running_totals(known, ["lang"], [F.col("source").asc()], {"one": "place"}, "audit-order").drop("one")
        .withColumn("n", F.lit(0).cast("long")).withColumn("p0", _share("n", "total")).drop("n"),
        "audit-places",
    )
    counts = single.join(groups, ["lang", "source"]).withColumns({"p": _share("n", "total"), "q": _share("n_all", "lang_total")})
    return groups, staged(counts.select("lang", "source", "term", "place", "n", "p", "p0", "q"), "audit-counts")


def pair_values(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """``lang``, places ``a`` < ``b`` and ``value``, the gaps of two sources summed over all kept terms.

    If no source had any term, all terms would add the gap of the two empty shares. A count alone
    adds its gap to the empty share of each other source; those depend on source and count only
    and are added up per (source, count). What two counts of a term give beyond that is the
    correction of a node and its ancestor in the tree of terms, whose paths are a term's
    nonzero counts in the order of sources.
    """
    path = F.array_sort(F.collect_list(F.struct("place", "n", "p", "p0"))).alias("path")
    paths = counts.groupBy("lang", "term").agg(path).groupBy("lang", "path").agg(F.count("*").alias("times"))
    # ranges go by a path's beginning, so that what is sampled for their bounds stays small
    begin = F.transform(F.slice("path", 1, RANGED), lambda x: F.struct(x["place"], x["n"]))
    tree = paths.repartitionByRange("lang", begin).sortWithinPartitions("lang", "path").mapInArrow(_tree, "lang string, a long, b long, value long")
    alone = (
        counts.groupBy("lang", "place", "p", "p0").agg(F.count("*").alias("times")).select("lang", "place", "p", "p0", "times", F.lit(False).alias("base"))
        .unionByName(groups.select("lang", "place", F.col("p0").alias("p"), "p0", F.col("kinds").alias("times"), F.lit(True).alias("base")))
        .withColumn("salt", F.pmod(F.xxhash64("place", "p", "base"), F.lit(SALTS)).cast("int"))
    )
    others = groups.select("lang", F.col("place").alias("other"), F.col("p0").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    value = F.when(F.col("base"), _gap("p0", "r")).otherwise(_gap("p", "r") - _gap("p0", "r")) * F.col("times")
    singles = (
        alone.join(others, ["lang", "salt"]).filter("place <> other and (not base or place < other)")
        .select("lang", F.least("place", "other").alias("a"), F.greatest("place", "other").alias("b"), value.alias("value"))
    )
    return singles.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).unionByName(tree.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit_sources(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS,
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: how far each source of a language is from the others.

    Each language keeps the terms that ``least`` of its documents have. Part ``pair`` lists all
    other sources of the language by the sum of the gaps of their shares, part ``term`` the
    ``top`` terms that the source has more of than its language. NULL in text, language or source is
    the empty string; a source without any term is a source; repeated rows are documents of
    their own; ties go by the item's bytes; a language with one source has no pairs, one without
    kept terms has pairs of value 0. An empty table gives no rows; other columns are left aside.
    """
    groups, counts = _counts(docs, text_col, lang_col, source_col, least)
    both = F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("own"), F.col("a").alias("other"))))
    pairs = pair_values(groups, counts).select("lang", "value", both.alias("s")).select("lang", "value", "s.own", "s.other")
    named = lambda key, name: groups.select("lang", F.col("place").alias(key), F.col("source").alias(name))
    pairs = pairs.join(named("own", "source"), ["lang", "own"]).join(named("other", "item"), ["lang", "other"])
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = counts.filter("p > q").select("lang", "source", F.col("term").alias("item"), _gap("p", "q").alias("value"))
    listed = lambda part, rows: rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return listed("pair", pairs.withColumn("rank", F.row_number().over(order))).unionByName(
        listed("term", terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    )


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit_sources(spark.read.parquet(f"{folder}/documents.parquet"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), words AS (
  SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), kinds AS (
  SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, k.v, (SELECT coalesce(sum(n), 0) FROM counts c WHERE c.lang = g.lang AND c.source = g.source) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kinds k USING (lang)
), shares AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
    (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * g.v))::HUGEINT AS p
  FROM groups g JOIN kept t USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
), whole AS (
  SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(n) + 2) // ((sum(sum(n)) OVER (PARTITION BY lang)) + 2 * (count(*) OVER (PARTITION BY lang))))::HUGEINT AS q
  FROM counts GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((
    SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM shares x JOIN shares y USING (lang, term)
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms
) WHERE rank <= 10
"""
