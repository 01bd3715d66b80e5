"""Column factories: row predicates and label mappings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from fluxbook.vocabulary import COUNTERPART_TYPES

VERSIONS = ("total", "excluding_grants", "excluding_concessional_finance")


def not_grant(column: str = "indicator") -> Column:
    """True for indicators that are not grants; NULL (so dropped) for a NULL indicator."""
    return ~F.lower(F.col(column)).contains("grant")


def not_grant_or_concessional(column: str = "indicator") -> Column:
    """True unless the indicator is a grant or concessional; "non-concessional" passes."""
    name = F.lower(F.col(column))
    concessional = name.contains("concessional") & ~name.rlike("non[-_ ]?concessional")
    return ~(name.contains("grant") | concessional)


def version_mask(version: str, column: str = "indicator") -> Column | None:
    """Row filter of an analysis version, None when the version keeps everything."""
    if version == "total":
        return None
    if version == "excluding_grants":
        return not_grant(column)
    if version == "excluding_concessional_finance":
        return not_grant_or_concessional(column)
    raise ValueError(f"Unknown version {version!r}; expected one of {VERSIONS}")


def reducible(version: str, column: str = "indicator") -> Column:
    """Rows a scenario may cut: grants, or grants plus concessional finance."""
    if version == "grants":
        return ~not_grant(column)
    if version == "concessional_finance":
        return ~not_grant_or_concessional(column)
    raise ValueError(f"Unknown version {version!r}; expected grants or concessional_finance")


def is_any(column: str, values: Iterable) -> Column:
    """Two-valued membership: a NULL is simply not a member."""
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def differs(column: str, value) -> Column:
    """Two-valued ``!=``: a NULL differs from every value and is kept."""
    return F.coalesce(F.col(column) != F.lit(value), F.lit(True))


def recode(column: str, mapping: Mapping, default: Column | None = None) -> Column:
    """CASE lookup over a small fixed mapping; unmapped rows get ``default`` (NULL)."""
    case = F.lit(None)
    first = True
    targets: dict = {}
    for source, target in mapping.items():
        targets.setdefault(target, []).append(source)
    for target, sources in targets.items():
        test = F.col(column).isin(*sources)
        case = F.when(test, F.lit(target)) if first else case.when(test, F.lit(target))
        first = False
    return case if default is None else case.otherwise(default)


def counterpart_type(column: str = "indicator") -> Column:
    return recode(column, COUNTERPART_TYPES)


def rank_in(column: str, ranks: Mapping[str, int], default: int) -> Column:
    return recode(column, ranks, F.lit(default))
