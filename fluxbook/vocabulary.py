"""Column sets, indicator codes and label maps.

The entries are data, not logic: they have to equal the published definitions for results
to be comparable.
"""

# --- column sets -------------------------------------------------------------------------

OUTPUT_GROUPER = ("year", "country", "continent", "income_level", "prices", "indicator_type")
DEBT_KEYS = ("year", "country", "counterpart_area")
GRANT_COLUMNS = (
    "year", "iso_code", "recipient", "continent", "donor", "counterpart_iso_code",
    "counterpart_type", "prices", "indicator", "value",
)
PROJECTION_INDEX = ("year", "donor")

# --- indicator vocabulary ----------------------------------------------------------------

COUNTERPART_TYPES = {
    "grants_bilateral": "Bilateral",
    "grants_multilateral": "Multilateral",
    "bilateral_concessional": "Bilateral",
    "bilateral_non_concessional": "Bilateral",
    "multilateral_concessional": "Multilateral",
    "multilateral_non_concessional": "Multilateral",
    "bonds": "Private",
    "banks": "Private",
    "other_private": "Private",
}
GRANT_INDICATORS = ("grants_bilateral", "grants_multilateral")

# Debt statistics codes. ``split`` holds (total, concessional) pairs, ``plain`` single codes.
DISBURSEMENT_CODES = {
    "split": {
        "bilateral": (("DT.DIS.BLAT.CD", "DT.DIS.BLTC.CD"),),
        "multilateral": (("DT.DIS.MLAT.CD", "DT.DIS.MLTC.CD"),),
    },
    "plain": {
        "bonds": ("DT.DIS.PBND.CD",),
        "banks": ("DT.DIS.PCBK.CD",),
        "other_private": ("DT.DIS.PROP.CD",),
    },
}
# Debt service: principal (AMT) and interest (INT) legs land under one indicator name.
DEBT_SERVICE_CODES = {
    "split": {
        "bilateral": (("DT.AMT.BLAT.CD", "DT.AMT.BLTC.CD"), ("DT.INT.BLAT.CD", "DT.INT.BLTC.CD")),
        "multilateral": (("DT.AMT.MLAT.CD", "DT.AMT.MLTC.CD"), ("DT.INT.MLAT.CD", "DT.INT.MLTC.CD")),
    },
    "plain": {
        "bonds": ("DT.AMT.PBND.CD", "DT.INT.PBND.CD"),
        "banks": ("DT.AMT.PCBK.CD", "DT.INT.PCBK.CD"),
        "other_private": ("DT.AMT.PROP.CD", "DT.INT.PROP.CD"),
    },
}

# --- donors ------------------------------------------------------------------------------

# Official donors outside the published "all official" group.
OTHER_OFFICIAL_DONORS = {
    1038: "UN Institute for Disarmament Research",
    962: "UN Conference on Trade and Development",
    1039: "UN Capital Development Fund",
    1045: "North American Development Bank",
    1401: "International Trade Centre",
    1406: "UN Industrial Development Organization",
    910: "Central American Bank for Economic Integration",
    1046: "UN Women",
    1047: "UN COVID-19 Response and Recovery Multi-Partner Trust Fund",
    1048: "Joint Sustainable Development Goals Fund",
    1049: "International Commission on Missing Persons",
    1050: "WHO Strategic Preparedness and Response Plan",
    1054: "World Organisation for Animal Health",
    915: "Asian Forest Cooperation Organisation",
    1055: "CGIAR",
}
EXTRA_AID_DONORS = (83,)
DAC_TOTAL = {"donor_code": 20001, "donor_name": "DAC Countries", "iso_code": "DAC"}

# --- groups, periods and labels ----------------------------------------------------------

COUNTRY_GROUPS = {
    "Developing countries": 1,
    "Low income": 2,
    "Lower middle income": 3,
    "Upper middle income": 4,
    "Africa": 7,
    "Europe": 8,
    "Asia": 9,
    "America": 10,
    "Oceania": 11,
}
COUNTERPART_ORDER = {"Bilateral": 1, "Multilateral": 2, "Private": 3, "China": 4}
UNRANKED = 99

# label -> (first year, last year, divisor)
AVERAGE_PERIODS = {
    "2010-2014": (2010, 2014, 5),
    "2018-2022": (2018, 2022, 5),
    "2024-2025 (projected)": (2024, 2025, 2),
}

INCOME_ORDER = ("Upper middle income", "Lower middle income", "Low income")
HIGH_INCOME = "High income"
CHINA_RELABELS = {"Bilateral": "Bilateral (excl. China)", "Private": "Private (excl. China)"}
FLOW_TYPE_TITLES = {
    "all": "all flows",
    "excluding_concessional": "excluding concessional finance",
}
SCENARIO_TITLES = {
    "scenario 1": "optimistic",
    "scenario 2": "realistic",
    "scenario 3": "pessimistic",
}

# --- wide projection workbook ------------------------------------------------------------

PROJECTION_FAMILIES = {
    "gni": ("gni", "gni_downside", "gni_realistic", "gni_upside"),
    "oda": ("oda_downside", "oda_realistic", "oda_upside"),
    "oda_gni": ("oda_gni_downside", "oda_gni_realistic", "oda_gni_upside"),
    "bilateral": ("bilateral_upside", "bilateral_realistic"),
    "multilateral": ("multilateral_upside", "multilateral_realistic"),
    "idrc": ("idrc", "idrc_downside"),
    "scholarship": ("scholarship",),
    "administrative": ("administrative",),
    "development_awareness": ("development_awareness",),
    "eui_contributions": ("eui_contributions",),
    "ukraine": ("ukraine", "ukraine_downside"),
    "health_bilateral": ("health_bilateral_upside", "health_bilateral_realistic"),
    "agriculture_bilateral": ("agriculture_bilateral_upside", "agriculture_bilateral_realistic"),
    "wash_bilateral": ("wash_bilateral_upside", "wash_bilateral_realistic"),
    "wb_multilateral": ("wb_multilateral_upside", "wb_multilateral_realistic"),
    "rdb_multilateral": ("rdb_multilateral_upside", "rdb_multilateral_realistic"),
    "un_multilateral": ("un_multilateral_upside", "un_multilateral_realistic"),
}
