"""Lookups and null-safe joins.

No broadcast hints: the lookup tables come from storage and may grow, so the choice between
a broadcast and a shuffled join is left to Spark's size threshold and to AQE.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


#: Shares into which rows with a NULL key are dealt.
SHARES = 64
LEFT_JOINS = ("left", "left_semi", "left_anti", "inner")


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", null_safe: bool = False) -> DataFrame:
    """Equi-join on keys that may be NULL in many rows of ``left``; the keys appear once.

    Rows with a NULL key would all meet in one task of a shuffled join. A share, by the hash of the
    whole row, is one more key and deals them out; rows without NULL have share 0 and stay
    together. With ``null_safe`` NULL matches NULL, and the rows of ``right`` with a NULL key (few, as it
    is a lookup) are repeated for every share; otherwise they match nothing and are left out.
    Right joins and full ones would return those repeats.
    """
    if how not in LEFT_JOINS:
        raise ValueError(f"spread_join is a {', '.join(LEFT_JOINS)} join, not {how!r}")
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    empty = reduce(lambda a, b: a | b, [F.col(f"__{k}").isNull() for k in keys])
    if null_safe:
        shares = F.when(empty, F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
        renamed = renamed.withColumn("__share_of", F.explode(shares))
    else:
        # always 0, but not a literal: the optimizer would make a filter of that, and no key
        zero = F.least(F.lit(0), F.length(F.col(f"__{keys[0]}").cast("string")))
        renamed = renamed.where(~empty).withColumn("__share_of", zero)
    vacant = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    dealt = left.withColumn("__share", F.when(vacant, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(SHARES))).otherwise(0).cast("int"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) if null_safe else F.col(k) == F.col(f"__{k}") for k in keys]
    match = reduce(lambda a, b: a & b, same, F.col("__share") == F.col("__share_of"))
    return dealt.join(renamed, match, how).drop("__share", "__share_of", *[f"__{k}" for k in keys])


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every shared column, NULL matching NULL."""
    return spread_join(left, right, [c for c in left.columns if c in right.columns], null_safe=True)


def unique_lookup(lookup: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    """One row per key. A second row for a key is an error, as a join with it would repeat rows.

    The check is a sum by the key, on which the join shuffles anyway.
    """
    clash = F.raise_error(F.concat(F.lit(f"lookup: more than one row for {', '.join(keys)} = "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
    one = F.struct(*values)
    return lookup.groupBy(*keys).agg(F.when(F.count("*") > 1, clash.cast(lookup.select(one.alias("v")).schema["v"].dataType)).otherwise(F.first(one)).alias("__row")).select(
        *keys, *[F.col(f"__row.{v}").alias(v) for v in values]
    )


def add_column_from(df: DataFrame, lookup: DataFrame, key: str, lookup_key: str,
                    value: str, output: str) -> DataFrame:
    """Left join one column of a lookup table with unique keys; unmatched rows get NULL."""
    slim = lookup.where(F.col(lookup_key).isNotNull()).select(F.col(lookup_key).alias(key), F.col(value).alias(output))
    return spread_join(df, unique_lookup(slim, [key], output), [key])


def add_iso_codes(df: DataFrame, isos: DataFrame, key: str, lookup_key: str = "name",
                  output: str = "iso_code") -> DataFrame:
    return add_column_from(df, isos, key, lookup_key, "iso_code", output)


def add_income_level(df: DataFrame, income_levels: DataFrame, key: str = "iso_code") -> DataFrame:
    return add_column_from(df, income_levels, key, "iso_code", "income_level", "income_level")


def add_donor_and_recipient_names(df: DataFrame, donors: DataFrame, recipients: DataFrame) -> DataFrame:
    """Names by code, as columns ``donor`` and ``recipient``."""
    donors = donors.select("donor_code", F.col("donor_name").alias("donor"))
    recipients = recipients.select("recipient_code", F.col("recipient_name").alias("recipient"))
    return df.join(donors, "donor_code", "left").join(recipients, "recipient_code", "left")


def add_gni(df: DataFrame, gni: DataFrame) -> DataFrame:
    return df.join(gni, ["year", "entity_code"], "left")


def add_gni_per_capita(df: DataFrame, gni_pc: DataFrame) -> DataFrame:
    return df.join(gni_pc, ["year", "entity_code"], "left")
