"""Consolidation tables derived from an order/line-item star schema.

Nations become companies, regions become groups of companies, order lines become
trial-balance and intercompany rows, orders become adjustment journals and events
become the audit log. Every table is a lazy DataFrame; nothing is cached or written.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions.amounts import journal_amount
from ledgerfold.schemas import (
    ASSET,
    CURRENT_ASSET,
    CURRENT_LIABILITY,
    EQUITY,
    EXPENSE,
    LIABILITY,
    MONEY,
    OTHER_ASSET,
    OTHER_LIABILITY,
    REVENUE,
)

ACCOUNT_WITHOUT_CHART = 48
LAST_GROUPED_ACCOUNT = 48
FS_GROUPS = 100_000
#: Parts into which the larger of two tables is dealt when each row meets each.
PARTS = 16


def _company_code(number) -> Column:
    return F.format_string("C%02d", number)


def _account_code(number: Column) -> Column:
    return (1000 + 10 * number).cast("string")


def _period_code(ts) -> Column:
    return F.concat(F.lit("Q"), F.quarter(ts), F.lit("_"), F.year(ts))


def _row_label(prefix: str, number) -> Column:
    return F.format_string(f"{prefix}%02d", number)


def _numbers(first: int, last, name: str) -> Column:
    return F.explode(F.sequence(F.lit(first), last)).alias(name)


def _each_with_each(large: DataFrame, small: DataFrame) -> DataFrame:
    """Every pair of two master tables' rows, as a join on a part number.

    The larger table is dealt to parts by a hash, the smaller has a copy in each part.
    """
    part = F.pmod(F.xxhash64(*large.columns), F.lit(PARTS)).cast("int")
    copies = small.select("*", _numbers(0, F.lit(PARTS - 1), "_part"))
    return large.withColumn("_part", part).join(copies, "_part").drop("_part")


def _fs_group(parent: str, number: str) -> Column:
    """A group's number within its parent, after the parent's own number."""
    return F.substr(F.col(parent), F.lit(2)).cast("bigint") * FS_GROUPS + F.col(number)


class StarSchemaBooks:
    """Same attributes as ``Books``, each derived on first use."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark = spark
        self._root = root
        self._tables: dict[str, DataFrame] = {}

    def _read(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._spark.read.parquet(f"{self._root}/{name}.parquet")
        return self._tables[name]

    def kept(self, path: str) -> "StarSchemaBooks":
        """The same tables, for a job that reads them often: order lines and journals are joined
        once, written to a new folder, and read from there."""
        lines = self._lines.select(
            "company_code", "partner_code", "period_code", "account_code", "contra_account",
            "amt", "l_returnflag",
        )
        own = StarSchemaBooks(self._spark, self._root)
        for name, df in (("_lines", lines), ("journal_batch", self.journal_batch)):
            df.write.parquet(f"{path}/{name.strip('_')}")
            own.__dict__[name] = self._spark.read.schema(df.schema).parquet(f"{path}/{name.strip('_')}")
        return own

    # ---- master data ----------------------------------------------------------------

    @cached_property
    def company(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self._read("nation").select(
            key.cast("bigint").alias("company_id"),
            _company_code("n_nationkey").alias("company_code"),
            F.col("n_name").alias("company_name"),
            F.when(key == F.col("n_regionkey"), "Parent")
            .when(key % 3 == 0, "Associate")
            .otherwise("Subsidiary")
            .alias("company_type"),
            _company_code("n_regionkey").alias("parent_company"),
            F.date_add(F.lit("2000-01-01").cast("date"), key).alias("company_est_date"),
            F.lit("Thailand").alias("country"),
            F.lit("THB").alias("currency"),
            F.lit(100.0).alias("consolidation_rate"),
            F.date_add(F.lit("2001-01-01").cast("date"), key).alias("company_start_date"),
            F.when(key % 4 == 0, F.lit("2021-12-31").cast("date")).alias("company_end_date"),
        )

    @cached_property
    def period(self) -> DataFrame:
        quarters = (
            self._read("orders")
            .groupBy(
                _period_code("o_orderdate").alias("period_code"),
                F.year("o_orderdate").alias("y"),
            )
            .agg(
                F.min("o_orderdate").cast("date").alias("period_date_from"),
                F.max("o_orderdate").cast("date").alias("period_date_to"),
            )
        )
        return (
            _each_with_each(self.company.select("company_code"), quarters)
            .select(
                "company_code",
                "period_code",
                F.concat(F.lit("Period "), "period_code").alias("period_description"),
                "period_date_from",
                "period_date_to",
                F.when(F.col("period_code") == "Q1_1997", "Open")
                .when(F.col("y") > 1997, "Never Open")
                .otherwise("Closed")
                .alias("period_status"),
            )
        )

    @cached_property
    def coa(self) -> DataFrame:
        sizes = (
            self._read("part")
            .select(F.col("p_size").alias("s"))
            .where(F.col("s") != ACCOUNT_WITHOUT_CHART)
            .distinct()
        )
        wk = F.expr("(s - 1) div 2")
        return (
            _each_with_each(self.company.select("company_code", "parent_company"), sizes)
            .withColumn("w", wk)
            .select(
                "company_code",
                _account_code(F.col("s")).alias("account_code"),
                F.concat(F.lit("Account "), "s").alias("account_name"),
                _fs_group("parent_company", "w").alias("fs_group"),
                _row_label("W", "w").alias("wk_group_row"),
            )
        )

    @cached_property
    def fs_group(self) -> DataFrame:
        groups = (
            self._read("part")
            .where(F.col("p_size") <= LAST_GROUPED_ACCOUNT)
            .select(F.expr("cast((p_size - 1) div 2 as int)").alias("w"))
            .distinct()
        )
        f = F.col("f")
        return (
            self.company.select("parent_company")
            .distinct()
            .select("parent_company", _numbers(0, F.lit((LAST_GROUPED_ACCOUNT - 1) // 2), "w"))
            .join(groups, "w", "left_semi")
            .withColumn("f", F.expr("cast(w div 2 as int)"))
            .select(
                _fs_group("parent_company", "w").alias("fs_group_id"),
                F.col("parent_company").alias("company_code"),
                _row_label("W", "w").alias("wk_group_row"),
                F.concat(F.lit("WK "), "w").alias("wk_group_name"),
                _row_label("F", "f").alias("fs_group_row"),
                F.concat(F.lit("FS "), "f").alias("fs_group_name"),
                F.when(f < 4, ASSET)
                .when(f < 6, LIABILITY)
                .when(f < 8, EQUITY)
                .when(f < 10, REVENUE)
                .otherwise(EXPENSE)
                .alias("account_type"),
                F.when(f < 2, CURRENT_ASSET)
                .when(f < 4, OTHER_ASSET)
                .when(f < 5, CURRENT_LIABILITY)
                .when(f < 6, OTHER_LIABILITY)
                .when(f < 8, EQUITY)
                .when(f < 10, REVENUE)
                .otherwise(EXPENSE)
                .alias("account_subtype"),
            )
        )

    # ---- facts ----------------------------------------------------------------------

    @cached_property
    def _owned_orders(self) -> DataFrame:
        """Orders with the company that placed them."""
        customers = self._read("customer").select(
            F.col("c_custkey").alias("o_custkey"),
            _company_code("c_nationkey").alias("company_code"),
        )
        return (
            self._read("orders")
            .withColumn("period_code", _period_code("o_orderdate"))
            .join(customers, "o_custkey")
        )

    @cached_property
    def _lines(self) -> DataFrame:
        """Order lines with owner, partner, account and contra account.

        Orders meet their owner before the lines join, so that the line table, by far
        the largest, moves as seldom as possible.
        """
        orders = self._owned_orders.select(
            F.col("o_orderkey").alias("l_orderkey"), "company_code", "period_code"
        )
        suppliers = self._read("supplier").select(
            F.col("s_suppkey").alias("l_suppkey"), _company_code("s_nationkey").alias("partner_code")
        )
        parts = self._read("part").select(
            F.col("p_partkey").alias("l_partkey"),
            _account_code(F.col("p_size")).alias("account_code"),
            _account_code(51 - F.col("p_size")).alias("contra_account"),
        )
        return (
            self._read("lineitem")
            .select(
                "l_orderkey",
                "l_partkey",
                "l_suppkey",
                F.col("l_extendedprice").cast(MONEY).alias("amt"),
                "l_returnflag",
            )
            .join(orders, "l_orderkey")
            .join(parts, "l_partkey")
            .join(suppliers, "l_suppkey")
        )

    @cached_property
    def trial_balance(self) -> DataFrame:
        """Two balancing rows per line, made in one pass over the lines."""
        signed = F.when(F.col("l_returnflag") == "R", -F.col("amt")).otherwise(F.col("amt"))
        return (
            self._lines.select(
                "company_code",
                "period_code",
                F.inline(
                    F.array(
                        F.struct("account_code", signed.cast(MONEY).alias("tb_amount")),
                        F.struct(
                            F.col("contra_account").alias("account_code"),
                            (-signed).cast(MONEY).alias("tb_amount"),
                        ),
                    )
                ),
            )
            .select(
                "company_code",
                "period_code",
                "account_code",
                "tb_amount",
                F.concat(
                    F.lit("TB_"), "company_code", F.lit("_"), "period_code", F.lit(".xlsx")
                ).alias("tb_file_name"),
            )
        )

    @cached_property
    def interco(self) -> DataFrame:
        """Sales between two different companies of one group, already negated."""
        parents = self.company.select("company_code", "parent_company")
        partners = parents.withColumnsRenamed(
            {"company_code": "partner_code", "parent_company": "partner_parent"}
        )
        return (
            self._lines.where(F.col("company_code") != F.col("partner_code"))
            .join(parents, "company_code")
            .join(partners, "partner_code")
            .where(F.col("parent_company") == F.col("partner_parent"))
            .select(
                "company_code",
                "period_code",
                F.col("partner_code").alias("rpt_interco_code"),
                "account_code",
                (-F.col("amt")).cast(MONEY).alias("rpt_amount"),
                F.concat(
                    F.lit("RPT_"), "company_code", F.lit("_"), "period_code", F.lit(".xlsx")
                ).alias("rpt_file_name"),
            )
        )

    @cached_property
    def journal_batch(self) -> DataFrame:
        """Journal headers with their order key and amount."""
        parents = self.company.select("company_code", "parent_company")
        urgent = F.col("o_orderpriority") == "1-URGENT"
        return (
            self._owned_orders.join(parents, "company_code")
            .select(
                F.format_string("%s_JV_%08d", "parent_company", "o_orderkey").alias("journal_no"),
                "period_code",
                F.col("parent_company").alias("parent_company_code"),
                "company_code",
                F.when(urgent, "Reclassify").otherwise("TakeEq").alias("journal_type"),
                F.concat(F.lit("Order "), "o_orderkey").alias("journal_description"),
                F.col("o_orderkey").alias("k"),
                F.col("o_totalprice").cast(MONEY).alias("amt"),
            )
        )

    @cached_property
    def journal_header(self) -> DataFrame:
        return self.journal_batch.drop("k", "amt")

    @cached_property
    def journal_line(self) -> DataFrame:
        """A debit and a credit per journal; every 97th credit is one too high."""
        k, amt = F.col("k"), F.col("amt")
        credit = F.when(k % 97 == 0, amt + 1).otherwise(amt).cast(MONEY)
        nothing = F.lit(None).cast(MONEY)
        return (
            self.journal_batch.select(
                "journal_no",
                "period_code",
                "k",
                F.inline(
                    F.array(
                        F.struct(
                            (k % 50 + 1).alias("s"), amt.alias("debit"), nothing.alias("credit")
                        ),
                        F.struct(
                            ((k + 25) % 50 + 1).alias("s"),
                            nothing.alias("debit"),
                            credit.alias("credit"),
                        ),
                    )
                ),
            )
            .select(
                "journal_no",
                "period_code",
                "k",
                _account_code(F.col("s")).alias("account_code"),
                F.concat(F.lit("Account "), "s").alias("account_name"),
                "debit",
                "credit",
            )
            .withColumn("journal_amount", journal_amount())
        )

    @cached_property
    def upload(self) -> DataFrame:
        """Uploaded rows with the file names as the users typed them."""
        return self._read("events").select(
            F.format_string("C%02d", F.col("user_id") % 25).alias("company_code"),
            F.lit("Q1_2024").alias("period_code"),
            F.concat(
                "event_type", F.lit("["), (F.col("user_id") % 3).cast("string"), F.lit("].xlsx")
            ).alias("raw_file_name"),
            F.col("ts").alias("tb_date_create"),
            F.col("value").cast(MONEY).alias("tb_amount"),
        )

    # ---- administration -------------------------------------------------------------

    @cached_property
    def plan(self) -> DataFrame:
        return self._read("region").select(
            F.concat(F.lit("P"), F.col("r_regionkey").cast("string")).alias("plan_code"),
            F.col("r_name").alias("plan_description"),
            (100 * (F.col("r_regionkey") + 1)).cast("double").alias("plan_price"),
        )

    @cached_property
    def subscription(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self._read("nation").select(
            _company_code("n_nationkey").alias("company_code"),
            F.concat(F.lit("P"), (key % 6).cast("string")).alias("plan_code"),
            F.lit("2021-01-01").cast("date").alias("start_date"),
            F.when(key % 4 == 0, F.lit("2021-12-31").cast("date")).alias("end_date"),
        )

    @cached_property
    def user(self) -> DataFrame:
        key = F.col("c_custkey")
        start = F.lit("2021-01-01 00:00:00").cast("timestamp_ntz")
        joined = start + F.make_dt_interval(F.lit(0), (key % 100000).cast("int"))
        return self._read("customer").select(
            key.alias("user_id"),
            F.col("c_name").alias("username"),
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias(
                "email"
            ),
            F.concat(F.lit("First"), (key % 7).cast("string")).alias("first_name"),
            F.col("c_mktsegment").alias("last_name"),
            F.col("c_nationkey").cast("bigint").alias("company_id"),
            (key % 50 == 0).alias("is_superuser"),
            (key % 10 == 0).alias("is_staff"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
            joined.alias("date_joined"),
            F.when(key % 3 != 0, joined + F.make_dt_interval(F.lit(1))).alias("last_login"),
        )

    @cached_property
    def group(self) -> DataFrame:
        return self._spark.sql(
            "select * from values (0, 'Manager'), (1, 'Accountant'), (2, 'Viewer')"
            " as t(group_id, group_name)"
        )

    @cached_property
    def user_group(self) -> DataFrame:
        key = F.col("c_custkey")
        first = F.when(key % 4 < 3, (key % 4).cast("int"))
        second = F.when(key % 20 == 0, F.lit(2))
        return (
            self._read("customer")
            .select(key.alias("user_id"), F.explode(F.array(first, second)).alias("group_id"))
            .where("group_id is not null")
        )

    @cached_property
    def content_type(self) -> DataFrame:
        return self._spark.sql(
            "select * from values (0, 'fin', 'view'), (1, 'fin', 'click'),"
            " (2, 'fin', 'purchase'), (3, 'auth', 'signup') as t(content_type_id, app_label, model)"
        )

    @cached_property
    def admin_log(self) -> DataFrame:
        kind = F.col("event_type")
        return self._read("events").select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("action_time"),
            "user_id",
            F.when(kind == "view", 0)
            .when(kind == "click", 1)
            .when(kind == "purchase", 2)
            .when(kind == "signup", 3)
            .otherwise(9)
            .alias("content_type_id"),
            F.col("user_id").cast("string").alias("object_id"),
            kind.alias("object_repr"),
            (F.col("event_id") % 3 + 1).cast("int").alias("action_flag"),
            F.col("props").alias("change_message"),
        )
