"""Size checks in front of broadcast hints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def below_broadcast_threshold(df: DataFrame, times: int = 1) -> bool:
    """True if ``times`` the optimizer's size for ``df`` is under the session's broadcast threshold.

    For a scan that size comes from the files themselves. Where it cannot be read (a remote
    client without the driver's plan) the answer is no.
    """
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    except AttributeError:
        return False
    return size * times <= limit


def broadcast_if_small(df: DataFrame, bound: DataFrame) -> DataFrame:
    """Broadcast ``df`` when ``bound``, a table with at least as many rows, is small enough.

    The optimizer multiplies sizes when it estimates a join, so a small joined table is never
    broadcast on its own account; beyond the threshold the join stays a shuffled one.
    """
    return F.broadcast(df) if below_broadcast_threshold(bound) else df
