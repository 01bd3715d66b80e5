"""Schemas of the landed source tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _I, _D, _TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampType()

DEBT = _schema(year=_TS, country=_S, counterpart_area=_S, value=_D, indicator=_S)
AID = _schema(year=_I, donor_code=_I, recipient_code=_I, prices=_S, indicator=_S, value=_D)
AID_TOTAL = _schema(year=_I, donor_code=_I, donor_name=_S, currency=_S, prices=_S, indicator=_S, value=_D)
DONOR_NAMES = _schema(donor_code=_I, donor_name=_S)
RECIPIENT_NAMES = _schema(recipient_code=_I, recipient_name=_S)
MACRO = _schema(iso_code=_S, year=_TS, indicator=_S, value=_D)
GNI = _schema(year=_I, entity_code=_S, value=_D)
DEFLATORS = _schema(year=_I, iso_code=_S, usd_usd_deflator=_D, lcu_lcu_deflator=_D, constant_usd_gni=_D)
FLOWS = _schema(
    year=_I, country=_S, continent=_S, income_level=_S, counterpart_area=_S, counterpart_type=_S,
    indicator=_S, indicator_type=_S, prices=_S, value=_D,
)
NET_FLOWS = _schema(
    year=_I, country=_S, continent=_S, income_level=_S, prices=_S, indicator_type=_S, value=_D, flow_type=_S,
)
SCENARIOS = _schema(
    year=_I, country=_S, continent=_S, income_level=_S, prices=_S, scenario=_S,
    inflows=_D, outflows=_D, net_flows=_D,
)
