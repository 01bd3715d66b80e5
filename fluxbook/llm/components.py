"""Connected components of a table of links, without a link or a component on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fluxbook.llm.staging import staged


def _smallest(edges: DataFrame) -> DataFrame:
    """Of each node ``u`` the smallest of its neighbours ``v`` and itself."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("least"))


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of ``a``, ``b``.

    Large stars and small stars in turn: every node hangs its larger neighbours below its
    smallest one, then its smaller ones and itself. Both keep components and shorten paths, so a
    few rounds are enough; minima are combined before they move, and joins on a hub with many
    links can be split. Each round is a table in the shared folder.
    """
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if now["n"] == 0 or tuple(now) == state:
            break
        state = tuple(now)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_smallest(both), F.col("u") == F.col("node")).filter("v > u")
            .select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct()
        )
        large = staged(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "stars")
        small = large.join(_smallest(large), F.col("u") == F.col("node"))
        edges = staged(
            small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v")))
            .filter("u <> v").distinct(),
            "links",
        )
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
