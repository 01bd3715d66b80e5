"""Operator 1: mix sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fluxbook.llm.staging import WORD, row_key, running_totals, staged, word_count

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Per source its size and its target number of words.

    ``sizes`` holds one row per document with ``source`` and ``size``. Sources in code-point
    order, NULL last, take the weights in turn. Together the targets make up all words; none is
    above ``most`` times its source, and what a bounded source leaves goes to the others by
    weight. With every bound at ``most * size`` and every share at ``weight * level``, the level
    at which the targets add up is the largest of ``(words - bounds before) / weights from here
    on`` along the sources sorted by bound per weight, so no loop is needed.
    """
    totals = staged(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.lit(1).cast("long").alias("one")), "mix-sources"
    )
    place = F.col("place")
    weighted = running_totals(totals, [], [F.col("source").asc_nulls_last()], {"one": "place"}, "mix-order").select(
        "source", "source_size", (F.col("source_size") * most).alias("bound"),
        F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (place % len(weights) + 1).cast("int")).alias("weight"),
    )
    weighted = staged(weighted.withColumn("ratio", F.col("bound") / F.col("weight")), "mix-weights")
    along = running_totals(
        weighted, [], [F.col("ratio").asc(), F.col("source").asc_nulls_last()],
        {"bound": "bound_before", "weight": "weight_before"}, "mix-level",
    )
    words, weight = totals.agg(F.sum("source_size")).first()[0] or 0, weighted.agg(F.sum("weight")).first()[0] or 0
    level = along.agg(F.max((F.lit(words) - F.col("bound_before")) / (F.lit(weight) - F.col("weight_before")))).first()[0] or 0.0
    target = F.least(F.col("bound").cast("double"), F.col("weight") * F.lit(float(level)))
    return weighted.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED,
) -> DataFrame:
    """Words that each document gives to a mix of the sources.

    Every document gets a hash-random key; the documents of a source, sorted by it, are taken
    from the start until the source's budget, the target without its fraction, is used up.
    Where the budget is above the source's size the whole source is taken again, up to ``most``
    times. The document at the cut gives only its first words, so a source's words add up to its
    budget exactly.

    Returns one row per document: the id, ``source``, ``size``, ``source_size``, ``target``,
    ``epochs`` (whole passes), ``taken``. NULL and empty texts have size 0 and give nothing;
    a NULL source is a source; a NULL id is hashed as such. Repeated rows are rows of their own
    and sit next to each other. An empty table gives no rows. Other columns are left aside.
    """
    placed = _placed(docs, id_col, text_col, source_col, weights, most, seed)
    return placed.select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", "epochs",
        (F.col("epochs") * F.col("size") + F.col("more")).cast("long").alias("taken"),
    )


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], most: int, seed: str, *kept: Column) -> DataFrame:
    """One row per document: what the mix takes, as whole passes (``epochs``) and the words ``more`` of a further one; and ``kept``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), F.md5(text.cast("binary"))))
    slim = staged(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("key"), *kept,
        ),
        "mix-sizes",
    )
    targets = source_targets(slim, weights, most)
    placed = running_totals(slim, ["source"], [F.col("key").asc(), F.col("id").asc_nulls_last(), F.col("size").asc()], {"size": "before"}, "mix-docs")
    t = targets.withColumnRenamed("source", "of")
    budget = F.floor("target").cast("long")
    whole = F.coalesce(F.expr("floor(target) div nullif(source_size, 0)"), F.lit(0)).cast("long")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before")
    joined = placed.join(t, placed["source"].eqNullSafe(t["of"])).withColumns({"budget": budget, "epochs": whole})
    return joined.withColumn("more", F.greatest(F.lit(0), F.least(rest, F.col("size"))).cast("long"))


def mixed_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED,
) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each once for every time that the mix of ``mix_sources`` takes it, and ``taken``.

    A document that the mix leaves out has no row, nor has one without words. The one at its source's cut has its first
    words only, with the spaces between them, in its last row. ``taken`` is the number of words of a row, so the rows of a source
    add up to its budget. Rows that are equal in all columns are taken together; columns of any name pass through.
    """
    whole_row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    placed = _placed(docs, id_col, text_col, source_col, weights, most, seed, row_key(id_col).alias("of_id"), whole_row.alias("of_row"))
    full = F.col("epochs") + (F.col("more") == F.col("size")).cast("long")
    takes = placed.filter("size > 0").groupBy("of_id", "of_row").agg(
        F.sum(full).alias("full"), F.max(F.when(F.col("more") < F.col("size"), F.col("more")).otherwise(0)).alias("cut"), F.first("size").alias("size")
    )
    takes = takes.filter("full > 0 or cut > 0")
    rows = docs.select(F.struct("*").alias("doc"), row_key(id_col).alias("of_id"), whole_row.alias("of_row")).dropDuplicates(["of_id", "of_row"])
    times = F.sequence(F.lit(1).cast("long"), F.col("full") + (F.col("cut") > 0).cast("long"))
    out = rows.join(takes, ["of_id", "of_row"]).withColumn("time", F.explode(times))
    last = F.col("time") > F.col("full")
    text = F.col("doc")[text_col]
    words = F.regexp_extract_all(text, F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("cut").cast("int")), "")
    kept = [F.when(last, cut).otherwise(text).alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns]
    return out.select(*kept, F.when(last, F.col("cut")).otherwise(F.col("size")).alias("taken"))


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{folder}/documents.parquet")).drop("source", "epochs")


OP1_SQL = r"""
WITH slim AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS bound,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM slim GROUP BY source
), along AS (
  SELECT *,
    coalesce(sum(bound) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bound_before,
    coalesce(sum(weight) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before
  FROM sources
), level AS (
  SELECT max(((SELECT sum(source_size) FROM sources) - bound_before)::DOUBLE / ((SELECT sum(weight) FROM sources) - weight_before)::DOUBLE) AS level
  FROM along
), targets AS (
  SELECT source, source_size, least(bound::DOUBLE, weight * level) AS target FROM sources, level
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM slim
), cut AS (
  SELECT p.*, t.source_size, t.target, coalesce(floor(target)::BIGINT // nullif(source_size, 0), 0) AS epochs
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(floor(target)::BIGINT - epochs * source_size - before, size)))::BIGINT AS taken
FROM cut
"""
