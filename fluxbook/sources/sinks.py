"""Sinks: CSV for report tables, parquet for facts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header. ``single_file`` is for chart tables, which hold a few hundred rows."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: str | None = "year", whole: bool = False) -> None:
    """Parquet by partition: rows of one value are brought together, so a value has a few files of a good size
    (a large one is split) however many tasks made them.

    A rerun replaces the partitions that it has rows for and leaves the others; ``whole`` replaces the table.
    """
    if partition_by is None:
        df.write.mode("overwrite").parquet(path)
        return
    together = df.hint("rebalance", partition_by)
    mode = "static" if whole else "dynamic"
    together.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(partition_by).parquet(path)


def land_debt(debt: DataFrame, path: str) -> None:
    """Debt facts by indicator code, so that ``scan_debt`` opens only the codes it needs."""
    write_parquet(debt, path, "indicator")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared folder (``spark.checkpoint.dir``).

    Only where that is unset and the master is local, as in tests, a temporary folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")
