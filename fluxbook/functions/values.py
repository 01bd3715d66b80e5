"""Helpers for the measure column. Operators keep its numeric type: decimals stay exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def columns_except(df: DataFrame, *excluded: str) -> list[str]:
    return [c for c in df.columns if c not in excluded]


def total(column: str | Column = "value") -> Column:
    """Sum in which a group of NULLs totals 0."""
    return F.coalesce(F.sum(column), F.lit(0))


def sum_by(df: DataFrame, keys, *measures: str) -> DataFrame:
    """Sum ``measures`` (default ``value``) by ``keys``; NULL keys form groups."""
    measures = measures or ("value",)
    return df.groupBy(*keys).agg(*[total(m).alias(m) for m in measures])


def sum_by_all_except(df: DataFrame, *excluded: str) -> DataFrame:
    return sum_by(df, columns_except(df, "value", *excluded))


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """Missing is always NULL: turn NaN in floating columns into NULL on ingest."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    names = [c for c in (columns or floating) if c in floating]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})


def scaled_type(df: DataFrame, column: str) -> T.DataType:
    """Type of a measure after scaling: a decimal gets enough digits for the product."""
    kind = df.schema[column].dataType
    return T.DecimalType(38, 8) if isinstance(kind, T.DecimalType) else T.DoubleType()


def multiply(df: DataFrame, factor: Column, column: str = "value") -> DataFrame:
    """Scale a measure in place. Rows with factor 1 keep their exact value."""
    kind = scaled_type(df, column)
    # Both branches in the wider type: a common type of the two would lose digits again.
    scaled = (F.col(column).cast("double") * factor).cast(kind)
    return df.withColumn(column, F.when(factor == 1.0, F.col(column).cast(kind)).otherwise(scaled))


def half_even(column: Column, digits: int) -> Column:
    """Banker's rounding, the rounding of the published tables."""
    return F.bround(column, digits)


def missing(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)
