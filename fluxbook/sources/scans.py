"""Scans of the source tables: filters and projections that reach the parquet reader."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fluxbook.functions.values import nan_to_null
from fluxbook.operators.joins import add_donor_and_recipient_names
from fluxbook.operators.scenarios import clean_columns
from fluxbook.vocabulary import EXTRA_AID_DONORS


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


BAD_ROW = "bad_row"


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header row and an explicit schema, so that no inference pass is needed. Headers are held against
    the schema; rows that do not fit it are left out, see ``read_csv_rows``."""
    return read_csv_rows(spark, path, schema).where(F.col(BAD_ROW).isNull()).drop(BAD_ROW)


def read_csv_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a CSV table with ``bad_row``, the text of a row with too few, too many or unreadable fields.

    A file whose header is not the schema's is an error. A bad row keeps the fields that can be read.
    """
    told = T.StructType([*schema.fields, T.StructField(BAD_ROW, T.StringType())])
    return (
        spark.read.schema(told).option("header", True).option("enforceSchema", False)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_ROW).csv(path)
    )


def bad_csv_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The texts of the rows that do not fit."""
    rows = read_csv_rows(spark, path, schema)
    # a query of that column alone would read nothing else, which the reader refuses
    return rows.where(F.col(BAD_ROW).isNotNull()).select(BAD_ROW, F.struct(*schema.names).alias("read"))


def scan_debt(debt: DataFrame, indicators: Iterable[str], start_year: int, end_year: int) -> DataFrame:
    """Some indicators of some years. The timestamp bounds are pushed to the scan, and the
    indicator list prunes partitions of a table written by ``land_debt``."""
    kind = debt.schema["year"].dataType
    debt = nan_to_null(debt)
    first, after = (F.lit(f"{y:04d}-01-01").cast(kind) for y in (start_year, end_year + 1))
    return debt.where(F.col("indicator").isin(*indicators) & (F.col("year") >= first) & (F.col("year") < after))


def scan_aid(aid: DataFrame, start_year: int, end_year: int, *, prices: str = "current",
             indicator: str | None = None, donors: Iterable[int] | None = None,
             donor_names: DataFrame | None = None, recipient_names: DataFrame | None = None) -> DataFrame:
    """Aid rows of some years, in one price basis, optionally of some donors and with names."""
    rows = nan_to_null(aid).where(F.col("year").between(start_year, end_year) & (F.col("prices") == prices))
    if indicator is not None:
        rows = rows.where(F.col("indicator") == indicator)
    if donors is not None:
        rows = rows.where(F.col("donor_code").isin(*donors))
    if donor_names is not None and recipient_names is not None:
        rows = rows.transform(add_donor_and_recipient_names, donor_names, recipient_names)
    return rows


def to_units(df: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """Source values are in millions."""
    return df.withColumn("value", F.col("value") * scale)


def scan_aid_totals(aid_total: DataFrame, dac_donors: Iterable[int], start_year: int, end_year: int,
                    prices: str = "current") -> DataFrame:
    """Official totals of the scenario donors, which are the DAC's and one more, in units."""
    donors = sorted({*dac_donors, *EXTRA_AID_DONORS})
    return scan_aid(aid_total, start_year, end_year, prices=prices, donors=donors).transform(to_units)


def scan_macro(macro: DataFrame, indicator: str, first_year: int = 2000) -> DataFrame:
    """One macro indicator by integer year, without rows that have no iso_code. The first year is
    a bound on the stored timestamp, which the reader can push down."""
    first = F.lit(f"{first_year:04d}-01-01").cast(macro.schema["year"].dataType)
    return (
        nan_to_null(macro)
        .where((F.col("indicator") == indicator) & F.col("iso_code").isNotNull() & (F.col("year") >= first))
        .withColumn("year", F.year("year"))
        .drop("indicator")
    )


def scan_aid_gni(aid: DataFrame, isos: DataFrame, start_year: int, end_year: int,
                 prices: str = "current", indicator: str = "gni") -> DataFrame:
    """An aid indicator by donor iso; codes that are not three letters (groups) drop out."""
    lookup = isos.select("donor_code", "iso_code").where(F.length("iso_code") == 3)
    return scan_aid(aid, start_year, end_year, prices=prices, indicator=indicator).join(lookup, "donor_code")


def scan_gni(gni: DataFrame) -> DataFrame:
    return nan_to_null(gni).select("year", "entity_code", F.col("value").alias("gni"))


def scan_gni_per_capita(gni_pc: DataFrame) -> DataFrame:
    return nan_to_null(gni_pc).select("year", "entity_code", F.col("value").alias("gni_pc"))


def scan_projections(wide: DataFrame, skip_year: int = 2024) -> DataFrame:
    """Wide projections with clean headers, without the year that is not projected."""
    return nan_to_null(wide.transform(clean_columns)).where(F.coalesce(F.col("year") != skip_year, F.lit(True)))


def scan_deflators(deflators: DataFrame) -> DataFrame:
    return nan_to_null(deflators).select("year", "iso_code", "usd_usd_deflator")


def dim_names(code_list: DataFrame, side: str, start_year: int = 2010, end_year: int = 2022) -> DataFrame:
    """Distinct (code, name) pairs of one side (donor or recipient) of the yearly code list."""
    years = F.col("year").between(start_year, end_year)
    return code_list.where(years).select(f"{side}_code", f"{side}_name").distinct()
