"""Debt codes to indicators, splitting totals into concessional and non-concessional.

The source publishes a total and its concessional part under separate codes. The split is
one conditional aggregation over one scan; no join of the two code slices is needed because
(code, year, country, counterpart_area) identifies a source row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fluxbook.functions.values import nan_to_null, total
from fluxbook.vocabulary import DEBT_KEYS


def concessional_split(debt: DataFrame, total_code: str, concessional_code: str, prefix: str) -> DataFrame:
    """Rows ``{prefix}_concessional`` and ``{prefix}_non_concessional`` per debt key.

    Keys without a total are left out. A missing concessional part stays NULL in its own row
    and counts as 0 in the non-concessional one.
    """
    codes = {
        "split": {prefix: ((total_code, concessional_code),)},
        "plain": {},
    }
    return debt_by_indicator(debt, codes)


def debt_by_indicator(debt: DataFrame, codes: dict) -> DataFrame:
    """All indicators of one code book (see vocabulary)."""
    return debt_by_direction(debt, {"inflow": codes}).drop("indicator_type")


def code_roles(books: Mapping[str, dict]) -> list[tuple]:
    """(code, family, leg, role, direction) of every code of some code books by direction."""
    roles = []
    for direction, codes in books.items():
        for name, pairs in codes["split"].items():
            for leg, (total_code, concessional_code) in enumerate(pairs):
                roles.append((total_code, name, leg, "total", direction))
                roles.append((concessional_code, name, leg, "concessional", direction))
        for name, plain in codes["plain"].items():
            roles += [(code, name, leg, "plain", direction) for leg, code in enumerate(plain)]
    return roles


def indicators_of_roles(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys``, indicator, direction and value from rows with ``family``, ``leg``, ``role``, ``indicator_type``, by one sum."""

    def part(kind):
        return F.when(F.col("role") == kind, F.col("value"))

    sums = rows.groupBy(*keys, "family", "leg", "indicator_type").agg(
        F.max(F.col("role") == "total").alias("has_total"),
        F.max(F.col("role") == "plain").alias("is_plain"),
        total(part("total")).alias("total"),
        F.sum(part("concessional")).alias("concessional"),
        F.sum(part("plain")).alias("plain"),
    )
    split = F.array(
        F.struct(F.concat("family", F.lit("_concessional")).alias("indicator"), F.col("concessional").alias("value")),
        F.struct(
            F.concat("family", F.lit("_non_concessional")).alias("indicator"),
            (F.col("total") - F.coalesce("concessional", F.lit(0))).cast(sums.schema["concessional"].dataType).alias("value"),
        ),
    )
    plain = F.array(F.struct(F.col("family").alias("indicator"), F.col("plain").alias("value")))
    return (
        sums.where("has_total or is_plain")
        .withColumn("out", F.explode(F.when(F.col("is_plain"), plain).otherwise(split)))
        .select(*keys, "out.indicator", "indicator_type", "out.value")
    )


def debt_by_direction(debt: DataFrame, books: dict[str, dict]) -> DataFrame:
    """Indicators of several code books, one per indicator type, in one scan and one shuffle.

    The legs of an indicator (principal and interest) stay separate rows, as in the source;
    they are summed when the flows are prepared.
    """
    # A local relation of a few dozen codes: Spark broadcasts it by its known size.
    names = ("indicator", "family", "leg", "role", "indicator_type")
    book = debt.sparkSession.createDataFrame(pa.table(dict(zip(names, zip(*code_roles(books))))))
    return indicators_of_roles(nan_to_null(debt, "value").join(book, "indicator"), DEBT_KEYS)
