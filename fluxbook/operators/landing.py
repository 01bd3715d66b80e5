"""One table for debt and aid, and the flows in it.

The two sources differ in their keys (names or codes), their units and their codes for an
indicator. Laid together as *landed* rows they pass through one scan, one sum and one set of
lookups, however many indicators a row serves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fluxbook.functions.values import nan_to_null
from fluxbook.operators.concessional import code_roles, indicators_of_roles
from fluxbook.sources.scans import to_units

DEBT, AID = "debt", "aid"
#: Columns of landed rows, with values in units. Debt has names, aid has codes; the others' are NULL.
LANDED = ("source", "indicator", "year", "country", "counterpart_area", "recipient_code", "donor_code", "prices", "value")
FLOW_KEYS = ("source", "year", "country", "counterpart_area", "recipient_code", "donor_code", "prices")


def route(facts: DataFrame, routes: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Each fact once for every (source, indicator) it serves, with the measure that serves it as ``value``.

    ``routes`` has the ``keys``, ``source``, ``indicator``, ``prices``, ``measure`` (a name of ``measures``) and
    ``times``. It is a small local relation, so the facts stay where they are.
    """
    value = F.coalesce(*[F.when(F.col("measure") == m, F.col(m)) for m in measures])
    rest = [c for c in facts.columns if c not in (*keys, *measures)]
    return facts.join(routes, list(keys)).select(*rest, "source", "indicator", "prices", (value * F.col("times")).alias("value"))


def land_together(debt: DataFrame, aid: DataFrame) -> DataFrame:
    """Landed rows of a debt table and one of aid in millions. Filters on source, year and prices reach both scans."""
    codes = {c: aid.schema[c].dataType for c in ("recipient_code", "donor_code")}
    owed = nan_to_null(debt, "value").select(
        F.lit(DEBT).alias("source"), "indicator", F.year("year").alias("year"), "country", "counterpart_area",
        *[F.lit(None).cast(k).alias(c) for c, k in codes.items()], F.lit("current").alias("prices"), "value",
    )
    given = nan_to_null(aid, "value").transform(to_units).select(
        F.lit(AID).alias("source"), "indicator", "year", *[F.lit(None).cast("string").alias(c) for c in ("country", "counterpart_area")],
        *codes, "prices", "value",
    )
    return owed.unionByName(given)


def flow_book(landed: DataFrame, books: Mapping[str, tuple[dict, int]], grants_until: int | None) -> DataFrame:
    """What each code is used for: indicator family, leg, role, direction and last year, as a local relation.

    ``books`` maps a direction to a code book (see vocabulary) and its last year. Aid, of whatever
    code, is one plain family up to ``grants_until``.
    """
    rows = [(DEBT, *role, books[role[-1]][1]) for role in code_roles({d: codes for d, (codes, _) in books.items()})]
    if grants_until is not None:
        rows.append((AID, AID, AID, 0, "plain", "inflow", grants_until))
    names = ("__source", "__code", "family", "leg", "role", "indicator_type", "__until")
    return landed.sparkSession.createDataFrame(pa.table(dict(zip(names, zip(*rows)))))


def flows_of_landed(landed: DataFrame, books: Mapping[str, tuple[dict, int]], first_year: int, grants_until: int | None,
                    prices: str = "current", grants_code: str | None = None) -> DataFrame:
    """``FLOW_KEYS``, indicator, direction and value of all flows, by one sum.

    Debt codes give plain indicators, or a total and its concessional part; what is left of the total is
    not concessional. Keys without a total are left out, a missing concessional part stays NULL in its
    own row and counts as 0 in the other. Legs (principal, interest) stay apart. Aid comes in the
    wanted ``prices`` under the indicator ``aid``. Rows of one key are summed; empty debt values drop out.
    """
    aid = F.col("source") == AID
    wanted = aid & (F.col("prices") == prices)
    if grants_code is not None:
        wanted = wanted & (F.col("indicator") == grants_code)
    last = max([until for _, until in books.values()] + ([] if grants_until is None else [grants_until]))
    rows = landed.where(F.col("year").between(first_year, last)).where((F.col("source") == DEBT) | wanted)
    book = flow_book(landed, books, grants_until)
    used = (F.col("source") == F.col("__source")) & (F.when(aid, F.lit(AID)).otherwise(F.col("indicator")) == F.col("__code"))

    flows = indicators_of_roles(rows.join(book, used).where(F.col("year") <= F.col("__until")), FLOW_KEYS)
    return flows.where((F.col("source") == AID) | (F.col("value") != 0))
