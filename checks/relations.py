"""The flow model's source tables, derived from the trade tables (TPC-H shape).

Customers' nations play the debtor countries, suppliers' nations the creditors. The facts
are reduced to one cube with integer keys before any name is attached, so that joins with
the small dimensions happen on the reduced data. Larger joins carry no hint: their strategy
follows from the measured sizes, and AQE splits skewed partitions.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fluxbook.functions import masks
from fluxbook.functions.sizes import broadcast_if_small
from fluxbook.functions.values import sum_by_all_except
from fluxbook.operators import series
from fluxbook.operators.landing import AID, DEBT, route
from fluxbook.operators.names import NameBook, NamePattern
from fluxbook.plans.flows import FlowSources
from fluxbook.settings import FlowSettings
from fluxbook.sources import scans
from fluxbook.vocabulary import COUNTERPART_TYPES, DEBT_SERVICE_CODES, DISBURSEMENT_CODES

MONEY = "decimal(18,4)"
INCOME = {0: "Low income", 1: "Lower middle income", 2: "Upper middle income", 3: "High income"}
# (line status, line number, return flag) -> indicator; only line 7 looks at the flag.
SHARED_LINES = {
    3: "bilateral_concessional", 4: "bilateral_non_concessional",
    5: "multilateral_concessional", 6: "multilateral_non_concessional",
}
STATUS_LINES = {
    "O": {1: "grants_bilateral", 2: "grants_multilateral", **SHARED_LINES},
    "F": {1: "bonds", 2: "banks", **SHARED_LINES},
}
FLAGS = {"A": "bonds", "N": "banks", "R": "other_private"}
INSTRUMENTS = [
    (status, line, flag, indicator)
    for status, lines in STATUS_LINES.items()
    for line, flag, indicator in [
        *[(n, "", i) for n, i in lines.items()], *[(7, f, i) for f, i in FLAGS.items()],
    ]
]
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
PERIODS = {"1995-1996": (1995, 1996, 2), "1997-1999": (1997, 1999, 3), "2000-2001": (2000, 2001, 2)}
GROUPS = {
    "Developing countries": 1, "Low income": 2, "Lower middle income": 3, "Upper middle income": 4,
    "AFRICA": 7, "EUROPE": 8, "ASIA": 9, "AMERICA": 10,
}
TRADE = FlowSettings(
    first_year=1995, last_year=2000, service_projection_years=4, latest_year=2000,
    last_service_year=2001, target_year=2004, outliers=("NATION_3", "NATION_7", "NATION_9"),
    china="NATION_8", africa="AFRICA", groups=GROUPS, periods=PERIODS,
)
ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
INSTRUMENT_KEYS = ("status", "line", "flag")
GRANT_LINES = "status = 'O' and line in (1, 2)"
BASE_YEAR = 1998
PROJECTION_SHIFT = 4
AID_DONORS = (*range(20), 21)


def code_rows() -> list[tuple[str, str, str, str]]:
    """(line status, indicator, debt code, measure) of every debt code."""
    rows = []
    for status, book in (("O", DISBURSEMENT_CODES), ("F", DEBT_SERVICE_CODES)):
        measures = ("principal", "interest")
        for family, pairs in book["split"].items():
            for measure, (total_code, concessional_code) in zip(measures, pairs):
                rows += [
                    (status, f"{family}_concessional", total_code, measure),
                    (status, f"{family}_non_concessional", total_code, measure),
                    (status, f"{family}_concessional", concessional_code, measure),
                ]
        for family, codes in book["plain"].items():
            rows += [(status, family, code, m) for m, code in zip(measures, codes)]
    return rows


PATTERNS = (
    *[
        NamePattern(f"(?i)^nation_{k}$", f"ISO_{k}", f"Country {k}", REGIONS[k % 5])
        for k in range(1, 25, 3)
    ],
    NamePattern("(?i)nation_1", "ISO_X", "Country X"),
)


def hundredths(column: str) -> Column:
    """A two-digit decimal stored as double, as an exact whole number of hundredths."""
    return F.rint(F.col(column) * 100).cast("bigint")


def money(units: Column) -> Column:
    """Whole 1/10000 units as exact money."""
    return (units.cast("decimal(28,0)") * F.lit("0.0001").cast("decimal(4,4)")).cast("decimal(28,4)")


def _new_year() -> Column:
    return F.to_timestamp_ntz(F.concat(F.col("year").cast("string"), F.lit("-01-01")), F.lit("yyyy-MM-dd"))


@lru_cache(maxsize=8)
def trade(spark: SparkSession, folder: str) -> "Trade":
    """One set of lazy relations per session and folder."""
    return Trade(spark, folder)


class Trade:
    """Lazy relations over one folder of trade tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str, *columns: str) -> DataFrame:
        """Columns of a table. The reader is kept, so its footers are read once."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name].select(*columns)

    # --- dimensions ----------------------------------------------------------------------

    @cached_property
    def nations(self) -> DataFrame:
        region = self.table("region", "r_regionkey", "r_name")
        return (
            self.table("nation", "n_nationkey", "n_name", "n_regionkey")
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .withColumn("level", F.expr("n_nationkey div 5"))
            .select(
                "n_nationkey", "n_name", F.col("r_name").alias("continent"),
                masks.recode("level", INCOME).alias("income_level"),
            )
        )

    @cached_property
    def isos(self) -> DataFrame:
        """name, donor_code -> iso_code; one group code of four letters, one nation with NULL."""
        key = F.col("n_nationkey")
        code = (
            F.when(key == 12, "USA").when(key == 23, "NX23")
            .when(key != 24, F.concat(F.lit("N"), F.lpad(key.cast("string"), 2, "0")))
        )
        return self.table("nation", "n_nationkey", "n_name").select(
            F.col("n_name").alias("name"), key.alias("donor_code"), code.alias("iso_code")
        )

    # --- the cube ------------------------------------------------------------------------

    @cached_property
    def orders_by_nation(self) -> DataFrame:
        customers = self.table("customer", "c_custkey", "c_nationkey")
        return self.table("orders", *ORDER_COLUMNS).join(
            customers, F.col("o_custkey") == F.col("c_custkey")
        ).withColumn("year", F.year("o_orderdate"))

    @cached_property
    def facts(self) -> DataFrame:
        """Line items with year, debtor and creditor nation keys, and instrument keys.

        Amounts are whole 1/10000 units: exact, and several times cheaper per row than a
        cast of a double to a decimal.
        """
        items = self.table(
            "lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_linestatus", "l_returnflag",
            "l_extendedprice", "l_discount", "l_tax",
        )
        suppliers = self.table("supplier", "s_suppkey", "s_nationkey")
        flag = F.when(F.col("l_linenumber") == 7, F.col("l_returnflag")).otherwise("")
        # Orders meet their customers first, so that the line items are shuffled for the
        # order key and the supplier key only.
        orders = broadcast_if_small(
            self.orders_by_nation.select("o_orderkey", "year", "c_nationkey"), self.table("orders", *ORDER_COLUMNS)
        )
        return (
            items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                "year", F.col("c_nationkey").alias("debtor"), F.col("s_nationkey").alias("creditor"),
                F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"), flag.alias("flag"),
                (hundredths("l_extendedprice") * (100 - hundredths("l_discount"))).alias("principal"),
                (hundredths("l_extendedprice") * hundredths("l_tax")).alias("interest"),
                (hundredths("l_extendedprice") * 100).alias("gross"),
            )
        )

    @cached_property
    def cube(self) -> DataFrame:
        """Facts summed by their six keys: bounded by the dimensions, whatever the facts."""
        measures = ("principal", "interest", "gross")
        return self.facts.groupBy("year", "debtor", "creditor", *INSTRUMENT_KEYS).agg(
            *[money(F.sum(F.col(m).cast("decimal(18,0)"))).alias(m) for m in measures]
        )

    @cached_property
    def instruments(self) -> DataFrame:
        """Instrument dimension as a local relation: filters on indicators fold into it."""
        columns = zip(("status", "line", "flag", "indicator"), zip(*INSTRUMENTS))
        return self.spark.createDataFrame(pa.table({
            name: pa.array(values, pa.int32() if name == "line" else pa.string()) for name, values in columns
        }))

    @cached_property
    def debt_codes(self) -> DataFrame:
        """Instrument keys -> debt codes and the measure each code reports."""
        columns = zip(("status", "indicator", "code", "measure"), zip(*code_rows()))
        codes = self.spark.createDataFrame(pa.table({n: pa.array(c, pa.string()) for n, c in columns}))
        return self.instruments.join(codes, ["status", "indicator"]).drop("indicator")

    def _labelled(self, facts: DataFrame) -> DataFrame:
        """Flow columns on facts or on the cube.

        To have debtor-years without outflows, or with concessional ones only, some payments
        are labelled as inflows.
        """
        remainder = (F.col("debtor") + F.col("year")) % 7
        concessional = F.col("line").isin(3, 5)
        turned = (remainder == 0) | ((remainder == 1) & ~concessional)
        outflow = (F.col("status") == "F") & ~turned
        creditor = self.table("nation", "n_nationkey", "n_name").toDF("creditor_key", "counterpart_area")
        return (
            facts.join(self.instruments, list(INSTRUMENT_KEYS))
            .join(self.nations, F.col("debtor") == F.col("n_nationkey"))
            .join(creditor, F.col("creditor") == F.col("creditor_key"))
            .select(
                "year", F.col("n_name").alias("iso_code"), F.col("n_name").alias("country"),
                "continent", "income_level", "counterpart_area",
                F.col("counterpart_area").alias("counterpart_iso_code"),
                masks.recode("indicator", COUNTERPART_TYPES).alias("counterpart_type"),
                "indicator", F.when(outflow, "outflow").otherwise("inflow").alias("indicator_type"),
                F.lit("current").alias("prices"),
                F.when(outflow, -F.col("principal")).otherwise(F.col("principal")).alias("value"),
            )
        )

    @cached_property
    def flow_rows(self) -> DataFrame:
        """Flows at the grain of the facts."""
        return self._labelled(self.facts.withColumn("principal", money(F.col("principal"))))

    @cached_property
    def flows(self) -> DataFrame:
        """The flow table without zero values. Two instruments may share an indicator, so a
        combination of labels can come in two rows; the reports sum them anyway."""
        return (
            self._labelled(self.cube)
            .drop("iso_code", "counterpart_iso_code")
            .where(F.col("value") != 0)
        )

    @cached_property
    def flow_table(self) -> DataFrame:
        """The flow table with one row per combination of labels."""
        return sum_by_all_except(self.flows)

    # --- raw debt and aid ----------------------------------------------------------------

    @cached_property
    def debt_raw(self) -> DataFrame:
        """Debt statistics by code. Creditor names carry stray blanks."""
        creditor = self.table("nation", "n_nationkey", "n_name").toDF("creditor_key", "creditor_name")
        amount = F.when(F.col("measure") == "principal", F.col("principal")).otherwise(F.col("interest"))
        return (
            self.cube.join(self.debt_codes, list(INSTRUMENT_KEYS))
            .groupBy("code", "year", "debtor", "creditor")
            .agg(F.sum(amount).alias("value"))
            .join(self.nations, F.col("debtor") == F.col("n_nationkey"))
            .join(creditor, F.col("creditor") == F.col("creditor_key"))
            .select(
                F.col("code").alias("indicator"), _new_year().alias("year"), F.col("n_name").alias("country"),
                F.concat(F.lit("  "), "creditor_name", F.lit(" ")).alias("counterpart_area"), "value",
            )
        )

    @cached_property
    def routes(self) -> DataFrame:
        """Instrument keys -> what they serve: a measure under each debt code, and grants in both price bases."""
        codes = [(status, line, flag, DEBT, code, "current", measure, 1)
                 for status, line, flag, indicator in INSTRUMENTS
                 for of, family, code, measure in code_rows() if (of, family) == (status, indicator)]
        grants = [("O", line, "", AID, "recipient_grants_flow", prices, "principal", times)
                  for line in (1, 2) for prices, times in (("current", 1), ("constant", 2))]
        names = (*INSTRUMENT_KEYS, "source", "indicator", "prices", "measure", "times")
        kinds = {"line": pa.int32(), "times": pa.int32()}
        return self.spark.createDataFrame(pa.table({
            n: pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*codes, *grants))
        }))

    @cached_property
    def landed(self) -> DataFrame:
        """Debt and aid in one table: each cell of the cube once per code it serves."""
        debtor, creditor = (self.table("nation", "n_nationkey", "n_name").toDF(f"{s}_key", f"{s}_name") for s in ("debtor", "creditor"))
        owed = F.col("source") == DEBT
        routed = route(self.cube.drop("gross"), self.routes, INSTRUMENT_KEYS, ("principal", "interest"))
        return (
            routed.join(debtor, F.col("debtor") == F.col("debtor_key")).join(creditor, F.col("creditor") == F.col("creditor_key"))
            .select(
                "source", "indicator", "year", F.when(owed, F.col("debtor_name")).alias("country"),
                F.when(owed, F.concat(F.lit("  "), "creditor_name", F.lit(" "))).alias("counterpart_area"),
                F.when(~owed, F.col("debtor")).alias("recipient_code"), F.when(~owed, F.col("creditor")).alias("donor_code"),
                "prices", "value",
            )
        )

    def _millions(self, value: Column) -> Column:
        return value.cast("decimal(24,4)") * F.lit("0.000001").cast("decimal(7,6)")

    @cached_property
    def aid_raw(self) -> DataFrame:
        """Grants by donor and recipient in millions; constant prices are double the current."""
        sums = self.cube.where(GRANT_LINES).groupBy("year", "debtor", "creditor").agg(
            F.sum("principal").alias("total")
        )
        bases = F.array(
            F.struct(F.lit("current").alias("prices"), F.lit(1).alias("times")),
            F.struct(F.lit("constant").alias("prices"), F.lit(2).alias("times")),
        )
        return sums.withColumn("basis", F.explode(bases)).select(
            "year", F.col("creditor").alias("donor_code"), F.col("debtor").alias("recipient_code"),
            "basis.prices", F.lit("recipient_grants_flow").alias("indicator"),
            self._millions(F.col("total") * F.col("basis.times")).alias("value"),
        )

    def _names(self, side: str) -> DataFrame:
        name = F.when(F.col("n_nationkey") >= 23, F.concat("n_name", F.lit(", Total"))).otherwise(F.col("n_name"))
        return self.table("nation", "n_nationkey", "n_name").select(
            F.col("n_nationkey").alias(f"{side}_code"), name.alias(f"{side}_name")
        )

    @cached_property
    def donor_names(self) -> DataFrame:
        return self._names("donor")

    @cached_property
    def recipient_names(self) -> DataFrame:
        return self._names("recipient")

    @cached_property
    def code_list(self) -> DataFrame:
        """Yearly rows with codes and names of both sides."""
        pairs = self.cube.where("status = 'O'").select(
            "year", F.col("creditor").alias("donor_code"), F.col("debtor").alias("recipient_code")
        )
        return pairs.join(self.donor_names, "donor_code").join(self.recipient_names, "recipient_code")

    @cached_property
    def aid_total(self) -> DataFrame:
        """Official totals by donor in millions. The USA's last year is one year earlier: later
        grants go by the next donor's name."""
        creditor = F.when((F.col("creditor") == 12) & (F.col("year") > 1999), 13).otherwise(F.col("creditor"))
        sums = self.cube.where(GRANT_LINES).groupBy("year", creditor.alias("creditor")).agg(
            F.sum("principal").alias("total")
        )
        names = self.table("nation", "n_nationkey", "n_name")
        return sums.join(names, F.col("creditor") == F.col("n_nationkey")).select(
            "year", F.col("creditor").alias("donor_code"), F.col("n_name").alias("donor_name"),
            F.lit("USD").alias("currency"), F.lit("current").alias("prices"),
            F.lit("total_oda").alias("indicator"), self._millions(F.col("total")).alias("value"),
        )

    @cached_property
    def aid(self) -> DataFrame:
        return scans.scan_aid_totals(self.aid_total, AID_DONORS, TRADE.first_year, TRADE.last_year)

    @cached_property
    def book(self) -> NameBook:
        """Aliases for every third nation, patterns for the next third, nothing for the rest."""
        key = F.col("n_nationkey")
        aliases = self.nations.where(key % 3 == 0).select(
            F.col("n_name").alias("alias"), F.concat(F.lit("ISO_"), key).alias("iso_code"),
            F.concat(F.lit("Country "), key).alias("name"), "continent",
        )
        return NameBook(aliases, PATTERNS)

    @cached_property
    def income_levels(self) -> DataFrame:
        return self.nations.where("income_level is not null").select(
            F.concat(F.lit("ISO_"), "n_nationkey").alias("iso_code"), "income_level"
        )

    def group(self, condition: str) -> DataFrame:
        return self.table("nation", "n_nationkey").where(condition).toDF("code")

    @cached_property
    def sources(self) -> FlowSources:
        names = self.table("nation", "n_name")
        deflators = self.deflators("concat('ISO_', n_nationkey)")
        return FlowSources(
            debt=self.debt_raw, aid=self.aid_raw, debtors=self.book, creditors=self.book,
            income_levels=self.income_levels, donor_names=self.donor_names,
            recipient_names=self.recipient_names,
            official_donors=self.group("n_nationkey < 20"),
            bilateral_donors=self.group("n_nationkey % 2 = 0"),
            developing_recipients=self.group("n_nationkey <> 24"),
            deflators=deflators, debtor_names=names, creditor_names=names, landed=self.landed,
        )

    # --- macro, GNI, projections ---------------------------------------------------------

    @cached_property
    def _nation_years(self) -> DataFrame:
        return self.orders_by_nation.groupBy("year", "c_nationkey").agg(
            F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("ngdp"),
            (F.count(F.lit(1)) * 1000).cast("double").alias("ngdp_r"),
            F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast(MONEY))).cast("double").alias("finished"),
        )

    def macro_by_nation(self, indicator: str) -> DataFrame:
        """One macro series by nation key, with a base year that has lost its key and a missing value."""
        if indicator == "NGDPD":
            rows = self.cube.groupBy("year", F.col("debtor").alias("c_nationkey")).agg(
                F.sum("gross").cast("double").alias("level")
            )
        else:
            rows = self._domestic.where(F.col("indicator") == indicator)
        return self._with_gaps(rows).select("c_nationkey", "year", "value")

    def _with_gaps(self, rows: DataFrame) -> DataFrame:
        gap = (F.col("c_nationkey") == 4) & (F.col("year") == 1997)
        lost = (F.col("c_nationkey") == 2) & (F.col("year") == BASE_YEAR)
        return rows.withColumns({"value": F.when(~gap, F.col("level")), "c_nationkey": F.when(~lost, F.col("c_nationkey"))})

    @cached_property
    def _domestic(self) -> DataFrame:
        """The three series of one aggregate. It always asks for both of its measures, so that
        every series, and every join of series, shares one shuffle."""
        levels = F.array(*[
            F.struct(F.lit(name).alias("indicator"), level.alias("level")) for name, level in (
                ("NGDP", F.col("ngdp")), ("NGDP_R", F.col("ngdp_r")), ("NGDP_D", 100 * F.col("ngdp") / F.col("ngdp_r")),
            )
        ])
        return self._nation_years.select("year", "c_nationkey", F.explode(levels).alias("s")).select("year", "c_nationkey", "s.*")

    @cached_property
    def macro(self) -> DataFrame:
        """The macro table; a scan of one indicator prunes the other branches."""
        domestic = self._with_gaps(self._domestic).select("c_nationkey", "year", "value", "indicator")
        rows = domestic.unionByName(self.macro_by_nation("NGDPD").withColumn("indicator", F.lit("NGDPD")))
        return rows.join(self.isos, F.col("c_nationkey") == F.col("donor_code"), "left").select(
            "iso_code", _new_year().alias("year"), "indicator", "value"
        )

    def series(self, indicator: str) -> DataFrame:
        return scans.scan_macro(self.macro, indicator, TRADE.first_year)

    def deflators(self, iso: str) -> DataFrame:
        """Base-100 price deflators under a chosen spelling of the iso code."""
        rows = self.macro_by_nation("NGDP_D").withColumnRenamed("c_nationkey", "n_nationkey")
        return (
            rows.withColumn("iso_code", F.expr(iso)).transform(series.price_deflator, BASE_YEAR)
            .select("iso_code", "year", (100 * F.col("value")).alias("deflator"))
        )

    def iso_deflators(self, indicator: str) -> DataFrame:
        index = series.price_deflator(self.series(indicator), BASE_YEAR)
        return index.select("iso_code", "year", (100 * F.col("value")).alias("deflator"))

    @cached_property
    def aid_gni(self) -> DataFrame:
        """GNI of donors as an aid indicator, in both price bases."""
        bases = F.array(
            F.struct(F.lit("current").alias("prices"), F.col("ngdp").alias("value")),
            F.struct(F.lit("constant").alias("prices"), (F.col("ngdp") * 1.37).alias("value")),
        )
        # ngdp_r counts orders and is never 0; asking for it shares the shuffle of the macro series
        return self._nation_years.where("ngdp_r > 0").withColumn("basis", F.explode(bases)).select(
            "year", F.col("c_nationkey").alias("donor_code"), "basis.prices",
            F.lit("gni").alias("indicator"), "basis.value",
        )

    def donor_gni(self, prices: str) -> DataFrame:
        return scans.scan_aid_gni(self.aid_gni, self.isos, TRADE.first_year, BASE_YEAR, prices).select(
            "year", "iso_code", "value"
        )

    def _gni_source(self, per_capita: bool) -> DataFrame:
        """Balances of the customers that ordered in a year; one nation's code is missing."""
        buyers = self.orders_by_nation.select("year", F.col("c_custkey").alias("buyer")).distinct()
        customers = self.table("customer", "c_custkey", "c_nationkey", "c_acctbal")
        level = (F.sum(F.col("c_acctbal").cast(MONEY)) * 1000).cast("double")
        rows = buyers.join(customers, F.col("buyer") == F.col("c_custkey")).groupBy("year", "c_nationkey").agg(
            (level / F.count(F.lit(1)) if per_capita else level).alias("value")
        )
        return rows.join(self.isos, F.col("c_nationkey") == F.col("donor_code")).select(
            "year", F.when(F.col("donor_code") != 11, F.col("iso_code")).alias("entity_code"), "value"
        )

    @cached_property
    def gni(self) -> DataFrame:
        return scans.scan_gni(self._gni_source(False))

    @cached_property
    def gni_pc(self) -> DataFrame:
        return scans.scan_gni_per_capita(self._gni_source(True))

    @cached_property
    def projections_raw(self) -> DataFrame:
        """Wide projections with workbook headers; only the first ten nations go by a name."""
        names = self.table("nation", "n_nationkey", "n_name").withColumn("n_name", F.when(F.col("n_nationkey") < 10, F.col("n_name")))
        # ngdp_r, never 0, is asked for to share the shuffle of the macro series, which the deflators come from
        rows = self._nation_years.where("ngdp_r > 0")
        return rows.join(names, F.col("c_nationkey") == F.col("n_nationkey")).select(
            (F.col("year") + PROJECTION_SHIFT).alias("Year"), F.col("n_name").alias("Donor"),
            (F.col("ngdp") * 3).alias("GNI Value"),
            F.col("ngdp").alias("ODA Realistic (constant USD)"),
            F.col("finished").alias("ODA Downside"),
            F.col("ngdp_r").alias("Health BL Realistic"),
            (F.col("ngdp_r") * 2).alias("WB ML Upside"),
            (F.col("ngdp_r") * 4).alias("Ag BL Upside_Value"),
        )

    @cached_property
    def projections(self) -> DataFrame:
        return scans.scan_projections(self.projections_raw, TRADE.latest_year + 1)

    @cached_property
    def projection_deflators(self) -> DataFrame:
        index = series.price_deflator(self.series("NGDP"), BASE_YEAR)
        table = index.select(
            (F.col("year") + PROJECTION_SHIFT).alias("year"), "iso_code",
            (100 * F.col("value")).alias("usd_usd_deflator"), F.lit(None).cast("double").alias("lcu_lcu_deflator"),
        )
        return scans.scan_deflators(table)
