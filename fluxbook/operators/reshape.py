"""Pivot with a uniqueness check, and the display orders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fluxbook.functions import masks
from fluxbook.sources.sinks import shared_folder
from fluxbook.vocabulary import COUNTERPART_ORDER, UNRANKED


def unpivot(df: DataFrame, ids: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Wide to long; NULL measures are kept."""
    return df.unpivot(list(ids), list(measures), "indicator", "value")


def pivot_unique(df: DataFrame, index: Sequence[str], column: str, values: Sequence[str],
                 measure: str = "value") -> DataFrame:
    """Long to wide without aggregating: a second row for one cell is an error, and so is a
    label that ``values`` does not list, NULL included, as its amount would be lost.

    The column labels are fixed up front, so this is one aggregation with no extra job to
    discover them.
    """
    cells = []
    unlisted = F.count(F.when(~F.coalesce(F.col(column).isin(*values), F.lit(False)), 1)) > 0
    lost = F.raise_error(F.lit(f"pivot: a label of {column} that is not listed"))
    for value in values:
        hit = F.col(column) == value
        clash = F.raise_error(F.lit(f"pivot: more than one row for {column}={value}"))
        cells.append(
            F.when(unlisted, lost)
            .when(F.count(F.when(hit, 1)) > 1, clash)
            .otherwise(F.max(F.when(hit, F.col(measure))))
            .alias(value)
        )
    return df.groupBy(*index).agg(*cells)


def list_order(column: str, listed: Sequence[str]) -> tuple[Column, Column]:
    """Sort keys: listed values in list order, the rest after them by their text."""
    ranks = {value: rank for rank, value in enumerate(listed)}
    text = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    return masks.rank_in(column, ranks, len(listed)), text


def custom_sort(df: DataFrame, column: str, listed: Sequence[str], *ties: str) -> DataFrame:
    """Order by ``list_order``; ``ties`` keeps a previous order inside equal values."""
    return df.orderBy(*list_order(column, listed), *ties)


def country_order(groups: Mapping[str, int], counterpart_type: bool = False) -> list[Column]:
    keys = [masks.rank_in("country", groups, UNRANKED), F.asc_nulls_last("country"), F.asc_nulls_last("year")]
    return keys + ([masks.rank_in("counterpart_type", COUNTERPART_ORDER, UNRANKED)] if counterpart_type else [])


def order_countries(df: DataFrame, groups: Mapping[str, int], counterpart_type: bool = False) -> DataFrame:
    return df.orderBy(*country_order(groups, counterpart_type))


def with_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Each row's place in an order, from 1, as a column that can be stored.

    The rows are sorted by range over as many partitions as there are, and written once to the shared folder, so
    that place and partition hold if a task is repeated. The sizes of the partitions, one row each, are summed up
    along the order; no task sees more than its own range. ``order`` should tell all rows apart.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "ranked")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({
        "__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
    })
    ranged.write.parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)
    before = W.orderBy("__of").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy(F.col("__part").alias("__of")).count()
    starts = sizes.select("__of", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    place = (F.col("__start") + F.col("__row") + 1).cast("long").alias(name)
    return rows.join(F.broadcast(starts), F.col("__part") == F.col("__of")).select(*df.columns, place)
