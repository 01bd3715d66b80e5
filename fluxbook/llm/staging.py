"""Tables written in the cluster's shared folder, and running totals over any order."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: What separates words in every contract of this subpackage; the same bytes as ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder ``spark.checkpoint.dir`` names; a temporary one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: short lineage, known size, no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def row_key(id_col: str) -> Column:
    """An id as a string that is never NULL; with ``text_hash`` it tells rows with different contents apart."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit("\x00"))


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc``, the whole row, so that no name of its columns clashes with others, and its ``key`` and ``hash``."""
    return docs.select(F.struct("*").alias("doc"), row_key(id_col).alias("key"), text_hash(text_col).alias("hash"))


def without(docs: DataFrame, id_col: str, text_col: str, rejected: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text are not among ``rejected`` (``id``, ``text_hash``)."""
    out = rejected.select(row_key("id").alias("key"), F.col("text_hash").alias("hash")).distinct()
    return keyed_rows(docs, id_col, text_col).join(out, ["key", "hash"], "left_anti").select("doc.*")


def running_totals(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], totals: dict[str, str], name: str
) -> DataFrame:
    """``df`` with the sum of each column of ``totals`` over the earlier rows of its group.

    The rows are sorted by range over group and order, so a large group spreads over many
    partitions. Each partition sums its own rows; the sums of earlier partitions, one row per
    group and partition, are added. ``totals`` maps a column to the name of its running sum,
    which leaves out the row itself. Group columns may be NULL.
    """
    keys = [F.col(c).asc_nulls_last() for c in group]
    ranged = staged(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), name)
    by = [F.col(c) for c in group]
    parts = ranged.groupBy("_part", *by).agg(*[F.sum(c).alias(f"_sum_{c}") for c in totals])
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in group],
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in totals],
    )
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in totals})
    same = local["_part"] == offsets["_p"]
    for c in group:
        same = same & local[c].eqNullSafe(offsets[f"_g_{c}"])
    return local.join(offsets, same).select(
        *[local[c] for c in df.columns], *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(out) for c, out in totals.items()]
    )
