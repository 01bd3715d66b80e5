"""Canonical country and creditor names.

Matching runs over the distinct names only: an exact alias first, else the first pattern
that fits, in list order. The answer is joined back on the name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fluxbook import creditor_names as fixed
from fluxbook.operators.joins import spread_join

FIELDS = ("iso_code", "name", "continent")


@dataclass(frozen=True)
class NamePattern:
    """A Java regular expression and what a matching name stands for."""

    pattern: str
    iso_code: str | None = None
    name: str | None = None
    continent: str | None = None


@dataclass(frozen=True)
class NameBook:
    """``aliases`` has columns alias, iso_code, name, continent and one row per alias. ``patterns`` is
    a sequence in order of preference, or a table with a ``rank``."""

    aliases: DataFrame
    patterns: Sequence[NamePattern] | DataFrame = ()


def alias_table(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Literal alias rows as a local relation, whose exact size the optimizer knows."""
    columns = list(zip(*rows)) if rows else [[] for _ in range(4)]
    fields = ("alias", *FIELDS)
    return spark.createDataFrame(
        pa.table({f: pa.array(c, pa.string()) for f, c in zip(fields, columns)})
    )


def debtor_aliases(spark: SparkSession) -> DataFrame:
    rows = [(a, r["iso_code"], r["name"], r["continent"]) for a, r in fixed.DEBTOR_ALIASES.items()]
    return alias_table(spark, rows)


def creditor_aliases(spark: SparkSession) -> DataFrame:
    """Multilaterals stand for themselves in both fields; former states map field by field."""
    isos = fixed.MULTILATERALS | fixed.CREDITOR_ISO_CODES
    names = fixed.MULTILATERALS | fixed.CREDITOR_SHORT_NAMES
    spellings = dict.fromkeys([*isos, *names])
    return alias_table(spark, [(s, isos.get(s), names.get(s), None) for s in spellings])


PATTERN_FIELDS = ("pattern", *FIELDS)
#: Length of the pieces of names by which patterns are found.
PIECE = 3
_GROUP = {"(": ")", "[": "]"}


def sure_literal(pattern: str) -> str:
    """The longest run of plain ASCII characters, in small letters, that every match must hold; empty if none is sure.

    Groups, classes and what a quantifier may leave out end a run. Alternatives at the top level, quoting and the
    comment mode leave nothing sure.
    """
    runs, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "|" or pattern.startswith(("\\Q", "(?x"), i):
            return ""
        if c == "\\":
            following = pattern[i + 1:i + 2]
            i += 2
            if following.isascii() and not following.isalnum():
                run += following
            else:
                runs, run = [*runs, run], ""
            continue
        if c in _GROUP:
            closing, depth = _GROUP[c], 0
            while i < len(pattern):
                if pattern[i] == "\\":
                    i += 1
                else:
                    depth += (pattern[i] == c) - (pattern[i] == closing)
                i += 1
                if not depth:
                    break
            runs, run = [*runs, run], ""
            continue
        if c in "?*{":
            runs, run = [*runs, run[:-1]], ""
            i = pattern.find("}", i) + 1 if c == "{" and "}" in pattern[i:] else i + 1
            continue
        if c in "+.^$" or not c.isascii():
            runs, run = [*runs, run], ""
        else:
            run += c
        i += 1
    return max([*runs, run], key=len).lower()


def pattern_table(spark: SparkSession, patterns: Sequence[NamePattern] | DataFrame) -> DataFrame:
    """``rank``, ``pattern``, what it stands for, and ``piece``, the beginning of its sure literal, as a small relation.

    A sequence is ranked by its order; a table brings ``rank`` and ``PATTERN_FIELDS`` with it.
    """
    if isinstance(patterns, DataFrame):
        rows = [tuple(r) for r in patterns.select("rank", *PATTERN_FIELDS).collect()]  # patterns are written by hand
    else:
        rows = [(n, *(getattr(p, f) for f in PATTERN_FIELDS)) for n, p in enumerate(patterns)]
    literals = [sure_literal(r[1]) for r in rows]
    pieces = [x[:PIECE] if len(x) >= PIECE else "" for x in literals]
    columns = list(zip(*rows)) if rows else [[] for _ in range(1 + len(PATTERN_FIELDS))]
    return spark.createDataFrame(pa.table({
        "rank": pa.array(columns[0], pa.int64()), **{f: pa.array(c, pa.string()) for f, c in zip(PATTERN_FIELDS, columns[1:])},
        "piece": pa.array(pieces, pa.string()),
    }))


def first_matches(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """``raw_name`` and ``hit``, what the first fitting pattern stands for, of the names that one fits.

    A name meets the patterns whose literal begins with one of its pieces of three letters, and those without
    a literal; only these are tried. So work grows with the patterns that may fit, not with all.
    """
    small = F.lower(F.col("raw_name"))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(small) - (PIECE - 1)))
    pieces = F.array_distinct(F.array_append(F.transform(places, lambda i: F.substring(small, i, F.lit(PIECE))), F.lit("")))
    return (
        names.where(F.col("raw_name").isNotNull()).withColumn("piece", F.explode(pieces))
        .join(patterns, "piece").where(F.expr("raw_name rlike pattern"))
        .groupBy("raw_name").agg(F.min_by(F.struct(*FIELDS), "rank").alias("hit"))
    )


def resolve_names(names: DataFrame, book: NameBook) -> DataFrame:
    """One-column table of names -> raw_name, iso_code, name, continent (NULL: no match)."""
    raw = names.toDF("raw_name").distinct()
    aliases = book.aliases.select("alias", *[F.col(f).alias(f"alias_{f}") for f in FIELDS])
    found = raw.join(aliases, F.col("raw_name") == F.col("alias"), "left")
    if not isinstance(book.patterns, DataFrame) and not book.patterns:
        return found.select("raw_name", *[F.col(f"alias_{f}").alias(f) for f in FIELDS])
    hits = first_matches(raw, pattern_table(names.sparkSession, book.patterns)).withColumnRenamed("raw_name", "__name")
    matched = found.join(hits, F.col("raw_name") == F.col("__name"), "left")
    return matched.select("raw_name", *[F.coalesce(f"alias_{f}", f"hit.{f}").alias(f) for f in FIELDS])


def _with_answers(df: DataFrame, column: str, book: NameBook, names: DataFrame | None) -> DataFrame:
    # Only the different names move; a name without an answer, or none at all, matches nothing.
    listed = df.select(column) if names is None else names
    answers = resolve_names(listed, book).select(
        F.col("raw_name").alias(column), *[F.col(f).alias(f"__{f}") for f in FIELDS]
    )
    return spread_join(df, answers, [column])


def clean_debtors(df: DataFrame, column: str, book: NameBook, names: DataFrame | None = None) -> DataFrame:
    """iso_code (NULL if unknown), short name and continent (raw name if unknown) up front.

    ``names`` may list the names of ``column``; without it they are read from the rows, once more.
    Each different name is resolved once.
    """
    rest = [c for c in df.columns if c not in (column, "iso_code", "continent")]
    return _with_answers(df, column, book, names).select(
        F.col("__iso_code").alias("iso_code"),
        F.coalesce("__name", column).alias(column),
        F.coalesce("__continent", column).alias("continent"),
        *rest,
    )


def clean_creditors(df: DataFrame, column: str, book: NameBook, names: DataFrame | None = None) -> DataFrame:
    """counterpart_iso_code and canonical name; an unknown creditor keeps its own name."""
    return (
        _with_answers(df, column, book, names)
        .withColumn("counterpart_iso_code", F.coalesce("__iso_code", column))
        .withColumn(column, F.coalesce("__name", column))
        .drop(*[f"__{f}" for f in FIELDS])
    )
