"""Positions in an order, rules in one pass, files as sources and sinks, report labels."""

import uuid

from pyspark.sql import functions as F

from ledgerfold.operators import contains, quality, rules
from ledgerfold.operators.journals import post_journals
from ledgerfold.operators.numbering import with_position
from ledgerfold.operators.shaping import has_rows, label
from ledgerfold.plans import admin, listings
from ledgerfold.plans import statements as st
from ledgerfold.schemas import ACCOUNT_SUBTYPES, ACCOUNT_TYPES, COMPANY_TYPES, LABELS, MONEY, PERIOD_STATUSES
from ledgerfold.session import scratch
from ledgerfold.sources import buckets, files
from ledgerfold.sources.books import Books
from registry import admin as admin_registry
from registry.inputs import PARENT, PERIOD, books, plain
from registry.statements import BS, FS, ONE, WK, report_measures, rpt_sql, statement_sql, working_sql
from registry.tables_sql import with_tables

# ---- positions ----------------------------------------------------------------------


def _report_bs_positions(spark, sf):
    lines = st.report(books(spark, sf), PARENT, PERIOD, "bs", total=False)
    return plain(with_position(lines, ["fs_group_row", "fs_group_name", "account_type", "account_subtype"]))


def _upload_summary_positions(spark, sf):
    summary = listings.upload_summary(books(spark, sf).upload, "raw_file_name")
    keys = ["-date_create", "company_code", "period_code", "raw_file_name"]
    return plain(with_position(summary, keys))


def _period_positions(spark, sf):
    """Periods by company, the latest first."""
    period = books(spark, sf).period.select("company_code", "period_code", "period_date_to")
    return with_position(period, ["company_code", "-period_date_to"])


def _journal_positions(spark, sf):
    header = books(spark, sf).journal_header.select("journal_no", "period_code")
    return with_position(header, ["journal_no"])


# ---- rules --------------------------------------------------------------------------


def _doctored(spark, sf) -> Books:
    """The books with faults: doubled accounts and users, odd types, lost groups and headers."""
    b = books(spark, sf)
    coa = b.coa.unionByName(b.coa.where(F.col("account_code").endswith("20"))).withColumn(
        "fs_group", F.when(F.col("account_code") == "1070", F.col("fs_group") + 7).otherwise(F.col("fs_group"))
    )
    odd = F.col("company_code").endswith("4")
    company = b.company.withColumn(
        "company_type", F.when(odd, "Branch").otherwise(F.col("company_type"))
    ).withColumn("company_name", F.when(odd, F.lit(None)).otherwise(F.col("company_name")))
    user = b.user.unionByName(b.user.where(F.col("user_id") % 100 == 0))
    header = b.journal_header.where(~F.col("journal_no").endswith("7"))
    line = b.journal_line.withColumn(
        "debit", F.when(F.col("debit") < 50_000, -F.col("debit")).otherwise(F.col("debit")).cast(MONEY)
    )
    return Books(
        company=company, period=b.period, coa=coa, fs_group=b.fs_group, trial_balance=b.trial_balance,
        interco=b.interco, journal_header=header, journal_line=line, plan=b.plan,
        subscription=b.subscription, user=user,
    )


def _check_unique_load(spark, sf):
    """Accounts as a batch, some of them twice and some already stored."""
    b = books(spark, sf)
    stored = b.coa.where(F.col("company_code") < "C10")
    return rules.check_unique_load(_doctored(spark, sf).coa, stored, ["company_code", "account_code"])


def _check_unique_load_periods(spark, sf):
    b = books(spark, sf)
    batch = b.period.where(F.col("period_code").endswith("_1997"))
    stored = b.period.where(F.col("period_status") != "Open")
    return rules.check_unique_load(batch, stored, ["company_code", "period_code"], "period_code")


def _check_domain_period(spark, sf):
    shut = quality.check_domain(books(spark, sf).period, "period_status", ["Open", "Closed"])
    return shut.select("company_code", "period_code", "period_status")


def _check_range_lines(spark, sf):
    broken = quality.check_range(_doctored(spark, sf).journal_line)
    return plain(broken.select("journal_no", "account_code", "debit", "credit"))


def _check_unique_accounts(spark, sf):
    return quality.check_unique(_doctored(spark, sf).coa, ["company_code", "account_code"])


def _check_unique_email(spark, sf):
    return quality.check_unique(_doctored(spark, sf).user, ["email"])


def _post_journals_empty(spark, sf):
    """Of the open period's journals, every fifth comes without lines and some without balance."""
    b = books(spark, sf)
    batch = b.journal_batch.where(F.col("period_code") == PERIOD).drop("amt")
    lines = b.journal_line.where(F.col("k") % 5 != 0)
    posting = post_journals(batch, lines, b.journal_header.limit(0), "k")
    return posting.rejected.select("k", "reason")


# ---- files --------------------------------------------------------------------------


def _read_tb(spark, sf):
    """One period's trial balance written as delimited text in another column order, read back."""
    path = scratch(spark, "tb")
    tb = books(spark, sf).trial_balance.where(F.col("period_code") == PERIOD)
    files.write_report(
        tb.select("tb_amount", F.lit("any").alias("account_name"), "account_code", "period_code", "company_code"),
        path,
    )
    return plain(
        files.read_tb(spark, path).rows.groupBy("company_code", "period_code", "account_code").agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum("tb_amount").alias("amount_sum"),
            F.count_if("unreadable").alias("unreadable_rows"),
        )
    )


def _read_tb_unreadable(spark, sf):
    """Amounts of some accounts written as words: F2 leaves them null and marks the row."""
    path = scratch(spark, "tb")
    tb = books(spark, sf).trial_balance.where(F.col("period_code") == PERIOD)
    word = F.when(F.col("account_code").endswith("50"), F.lit("n/a")).otherwise(F.col("tb_amount").cast("string"))
    files.write_report(
        tb.select("company_code", "period_code", "account_code", F.lit("any").alias("account_name"),
                  word.alias("tb_amount")), path)
    return files.read_tb(spark, path).rows.groupBy("account_code").agg(
        F.count_if("unreadable").alias("unreadable_rows"), F.count("tb_amount").alias("amounts")
    )


def _read_interco(spark, sf):
    """Intercompany rows as Parquet files of two schemas, one with its amounts as text."""
    path = scratch(spark, "rpt")
    rows = books(spark, sf).interco.drop("rpt_file_name").withColumn("account_name", F.lit(None).cast("string"))
    text = F.col("company_code") < "C12"
    rows.where(~text).write.parquet(path)
    rows.where(text).withColumn("rpt_amount", F.col("rpt_amount").cast("string")).write.mode("append").parquet(path)
    return plain(
        files.read_interco(spark, path, "parquet").rows
        .groupBy("company_code", "rpt_interco_code", "account_code")
        .agg(F.count(F.lit(1)).alias("row_count"), F.sum("rpt_amount").alias("amount_sum"))
    )


def _read_coa(spark, sf):
    """Master data by position, under header names of its own."""
    path = scratch(spark, "coa")
    files.write_report(books(spark, sf).coa.toDF("Company", "Code", "Name", "Group", "Row"), path)
    return files.read_coa(spark, path)


def _read_fs_group(spark, sf):
    path = scratch(spark, "fs")
    names = ["company_code", "wk_group_row", "wk_group_name", "fs_group_row", "fs_group_name",
             "account_type", "account_subtype"]
    files.write_report(books(spark, sf).fs_group.select(*names), path)
    return files.read_fs_group(spark, path)


def _write_report(spark, sf):
    """A finished statement exported, and the exported file read as it is."""
    path = scratch(spark, "export")
    files.write_report(plain(st.report(books(spark, sf), PARENT, PERIOD, "bs")), path)
    return spark.read.option("header", True).schema(
        "account_type string, account_subtype string, fs_group_row string, fs_group_name string,"
        " separate_fs double, consolidated_fs double"
    ).csv(path).na.fill("")


def _empty_sources(spark, sf):
    """Which sources have rows at all in some periods."""
    b = books(spark, sf)
    out = []
    for period in (PERIOD, "Q1_2030"):
        for name in ("trial_balance", "interco", "journal_header"):
            df = getattr(b, name).where(F.col("period_code") == period)
            out.append((period, name, has_rows(df)))
    return spark.createDataFrame(out, "period_code string, table_name string, found boolean")


def _journals_bucketed(spark, sf):
    """Sums of journals stored in buckets, with their headers."""
    prefix = f"books_{uuid.uuid4().hex}"
    b = books(spark, sf)
    own = Books(journal_header=b.journal_header, journal_line=b.journal_line)
    buckets.write_journals(own, scratch(spark, "journals"), prefix, 8)
    found = buckets.journal_sums(buckets.with_journals(own, spark, prefix))
    return plain(found.select("journal_no", "company_code", "line_count", "sum_debit", "sum_credit"))


def _indexed(table, key, column, text):
    def query(spark, sf):
        df = getattr(books(spark, sf), table)
        path = scratch(spark, "pieces")
        contains.write_index(df, path, key, [column])
        return contains.search(df, path, key, column, text).select(key, column)

    return query


QUERIES = {
    "search_log_indexed": _indexed("admin_log", "id", "change_message", '"K": 8'),
    "search_journals_indexed": _indexed("journal_header", "journal_no", "journal_description", "der 12"),
    "search_users_indexed": _indexed("user", "user_id", "email", "0"),
    "report_bs_positions": _report_bs_positions,
    "upload_summary_positions": _upload_summary_positions,
    "period_positions": _period_positions,
    "journal_positions": _journal_positions,
    "check_all": lambda spark, sf: rules.check_all(_doctored(spark, sf)),
    "check_unique_load": _check_unique_load,
    "check_unique_load_periods": _check_unique_load_periods,
    "check_domain_period": _check_domain_period,
    "check_range_lines": _check_range_lines,
    "check_unique_accounts": _check_unique_accounts,
    "check_unique_email": _check_unique_email,
    "post_journals_empty": _post_journals_empty,
    "read_tb": _read_tb,
    "read_tb_unreadable": _read_tb_unreadable,
    "read_interco": _read_interco,
    "read_coa": _read_coa,
    "read_fs_group": _read_fs_group,
    "write_report": _write_report,
    "empty_sources": _empty_sources,
    "journals_bucketed": _journals_bucketed,
    "rpt_result_labels": lambda spark, sf: label(
        plain(st.rpt_result(books(spark, sf), PARENT, PERIOD)), LABELS["rpt_result"]
    ),
    "working_bs_labels": lambda spark, sf: label(
        plain(st.working(books(spark, sf), PARENT, PERIOD, "bs")), LABELS["working"]
    ),
    "subscription_report_labels": lambda spark, sf: label(
        admin.subscription_report(books(spark, sf)), LABELS["subscription"]
    ),
    "user_report_labels": lambda spark, sf: label(admin.user_report(books(spark, sf)), LABELS["user"]),
    "admin_log_report_labels": lambda spark, sf: label(
        admin.admin_log_report(books(spark, sf)), LABELS["admin_log"]
    ),
}

# ---- the same in SQL ----------------------------------------------------------------


def _labelled(query: str, name: str) -> str:
    """A query's columns under report labels, written out after its common table expressions."""
    return f"select * rename ({', '.join(f'{k} as "{v}"' for k, v in LABELS[name].items())}) from ({query})"


def _values(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_DOCTORED = """
d_coa as (
  select company_code, account_code, account_name,
         case when account_code = '1070' then fs_group + 7 else fs_group end as fs_group, wk_group_row
  from (select * from fx_coa union all select * from fx_coa where account_code like '%20')),
d_company as (
  select * replace (case when company_code like '%4' then 'Branch' else company_type end as company_type,
                    case when company_code like '%4' then null else company_name end as company_name)
  from fx_company),
d_user as (select * from fx_user union all select * from fx_user where user_id % 100 = 0),
d_header as (select * from fx_jheader where journal_no not like '%7'),
d_line as (
  select * replace (cast(case when debit < 50000 then -debit else debit end as decimal(15,2)) as debit)
  from fx_journal)"""
_DOCTORED_TABLES = ("fx_coa", "fx_company", "fx_user", "fx_jheader", "fx_journal")


def _doctored_sql(query: str, *more: str) -> str:
    return with_tables(f"with {_DOCTORED.strip()}\n{query.strip()}", *_DOCTORED_TABLES, *more)


def _rule(table: str, rule: str, source: str, where: str) -> str:
    return f"select '{table}' as table_name, '{rule}' as rule, count(*) as violations from {source} where {where}"


def _doubled(table: str, keys: str, source: str) -> str:
    nulls = " and ".join(f"{k} is not null" for k in keys.split(","))
    return _rule(table, f"unique:{keys}",
                 f"(select {keys} from {source} where {nulls} group by {keys} having count(*) > 1)", "true")


_LENGTHS = {
    "company": ("d_company", {"company_code": 5, "company_name": 100, "company_type": 100, "parent_company": 5,
                              "country": 100, "currency": 3}),
    "period": ("fx_period", {"company_code": 5, "period_code": 7, "period_description": 100}),
    "coa": ("d_coa", {"company_code": 5, "account_code": 15, "account_name": 255, "wk_group_row": 10}),
    "fs_group": ("fx_fsgroup", {"company_code": 5, "wk_group_row": 10, "wk_group_name": 255, "fs_group_row": 10,
                                "fs_group_name": 255}),
    "plan": ("fx_plan", {"plan_code": 5, "plan_description": 100}),
    "subscription": ("fx_subscription", {"company_code": 5, "plan_code": 5}),
    "trial_balance": ("fx_tb", {"company_code": 5, "period_code": 7, "account_code": 15, "tb_file_name": 255}),
    "interco": ("fx_interco", {"company_code": 5, "period_code": 7, "account_code": 15, "rpt_interco_code": 5,
                               "rpt_file_name": 255}),
    "journal_header": ("d_header", {"journal_no": 15, "period_code": 7, "company_code": 5,
                                    "journal_description": 1000}),
    "journal_line": ("d_line", {"journal_no": 15, "account_code": 15, "account_name": 255}),
}
_CHECKS = [
    *(_rule(t, f"length:{c}", source, f"length({c}) > {n}")
      for t, (source, columns) in _LENGTHS.items() for c, n in columns.items()),
    _rule("company", "required:company_code", "d_company", "company_code is null"),
    _rule("company", "required:company_name", "d_company", "company_name is null"),
    _rule("company", "domain:company_type", "d_company", f"company_type not in {_values(COMPANY_TYPES)}"),
    _rule("period", "domain:period_status", "fx_period", f"period_status not in {_values(PERIOD_STATUSES)}"),
    _rule("fs_group", "domain:account_type", "fx_fsgroup", f"account_type not in {_values(ACCOUNT_TYPES)}"),
    _rule("fs_group", "domain:account_subtype", "fx_fsgroup", f"account_subtype not in {_values(ACCOUNT_SUBTYPES)}"),
    _rule("coa", "orphan:fs_group", "d_coa", "fs_group not in (select fs_group_id from fx_fsgroup)"),
    _rule("trial_balance", "too_long:tb_amount", "fx_tb", "abs(tb_amount) >= 10000000000000"),
    _rule("interco", "too_long:rpt_amount", "fx_interco", "abs(rpt_amount) >= 10000000000000"),
    _rule("journal_line", "negative:debit", "d_line", "debit < 0"),
    _rule("journal_line", "negative:credit", "d_line", "credit < 0"),
    _rule("journal_header", "scope:period_code", "d_header h",
          "not exists (select 1 from fx_period p where p.period_status = 'Open'"
          " and p.company_code = h.parent_company_code and p.period_code = h.period_code)"),
    _rule("journal_header", "scope:company_code", "d_header h",
          "not exists (select 1 from d_company c where c.parent_company = h.parent_company_code"
          " and c.company_code = h.company_code)"),
    _rule("journal_line", "orphan:journal_no", "d_line l",
          "not exists (select 1 from d_header h where h.journal_no = l.journal_no)"),
    _rule("journal_line", "scope:account_code", "d_line l join d_header h on h.journal_no = l.journal_no",
          "not exists (select 1 from d_coa a where a.company_code = h.parent_company_code"
          " and a.account_code = l.account_code)"),
    _doubled("company", "company_code", "d_company"),
    _doubled("company", "company_name", "d_company"),
    _doubled("period", "company_code,period_code", "fx_period"),
    _doubled("coa", "company_code,account_code", "d_coa"),
    _doubled("fs_group", "company_code,wk_group_row", "fx_fsgroup"),
    _doubled("plan", "plan_code", "fx_plan"),
    _doubled("plan", "plan_description", "fx_plan"),
    _doubled("subscription", "company_code", "fx_subscription"),
    _doubled("user", "email", "d_user"),
    _rule("period", "one_open", "(select company_code from fx_period where period_status = 'Open'"
          " group by company_code having count(*) > 1)", "true"),
    _rule("journal_line", "balanced", "(select journal_no from d_line group by journal_no"
          " having sum(coalesce(debit, 0)) <> sum(coalesce(credit, 0)))", "true"),
]

SQL = {
    "search_log_indexed": with_tables("""
select id, change_message from fx_admin_log where contains(lower(change_message), '"k": 8')""", "fx_admin_log"),
    "search_journals_indexed": with_tables("""
select journal_no, journal_description from fx_jheader
where contains(lower(journal_description), 'der 12')""", "fx_jheader"),
    "search_users_indexed": with_tables(
        "select user_id, email from fx_user where contains(email, '0')", "fx_user"),
    "report_bs_positions": statement_sql(f"""
select *, row_number() over (order by fs_group_row, fs_group_name, account_type, account_subtype) as position
from (select {FS}, {report_measures('')} from m where {ONE} and account_type in {BS} group by {FS})"""),
    "upload_summary_positions": with_tables("""
select *, row_number() over (order by date_create desc, company_code, period_code, raw_file_name) as position
from (select company_code, period_code, date_trunc('minute', tb_date_create) as date_create, raw_file_name,
             cast(sum(tb_amount) as double) as amount_sum,
             strftime(date_trunc('minute', tb_date_create), '%-d %b %Y %H:%M') as date_label
      from fx_upload group by all)""", "fx_upload"),
    "period_positions": with_tables("""
select company_code, period_code, period_date_to,
       row_number() over (order by company_code, period_date_to desc) as position from fx_period""", "fx_period"),
    "journal_positions": with_tables("""
select journal_no, period_code, row_number() over (order by journal_no) as position from fx_jheader""",
                                     "fx_jheader"),
    "check_all": _doctored_sql(
        "select * from (" + "\nunion all ".join(_CHECKS) + ") where violations > 0",
        "fx_period", "fx_fsgroup", "fx_tb", "fx_interco", "fx_plan", "fx_subscription"),
    "check_unique_load": _doctored_sql("""
select company_code, account_code, count(*) as batch_rows, company_code < 'C10' as stored
from d_coa group by company_code, account_code having count(*) > 1 or company_code < 'C10'"""),
    "check_unique_load_periods": with_tables("""
select company_code, period_code, 1::bigint as batch_rows, true as stored
from fx_period where period_code like '%_1997' and period_status <> 'Open'""", "fx_period"),
    "check_domain_period": with_tables("""
select company_code, period_code, period_status from fx_period where period_status not in ('Open', 'Closed')""",
                                       "fx_period"),
    "check_range_lines": _doctored_sql("""
select journal_no, account_code, cast(debit as double) as debit, cast(credit as double) as credit
from d_line where debit < 0 or credit < 0 or abs(debit) >= 1e13 or abs(credit) >= 1e13"""),
    "check_unique_accounts": _doctored_sql("""
select company_code, account_code, count(*) as row_count from d_coa
group by company_code, account_code having count(*) > 1"""),
    "check_unique_email": _doctored_sql(
        "select email, count(*) as row_count from d_user group by email having count(*) > 1"),
    "post_journals_empty": with_tables("""
with verdict as (
  select k, sum(coalesce(debit, 0)) - sum(coalesce(credit, 0)) as difference from fx_journal group by k)
select h.k, case when h.k % 5 = 0 then 'empty' else 'unbalanced' end as reason
from fx_jheader h join verdict v on h.k = v.k
where h.period_code = 'Q1_1997' and (h.k % 5 = 0 or v.difference <> 0)""", "fx_jheader", "fx_journal"),
    "read_tb": with_tables("""
select company_code, period_code, account_code, count(*) as row_count, cast(sum(tb_amount) as double) as amount_sum,
       0::bigint as unreadable_rows
from fx_tb where period_code = 'Q1_1997' group by all""", "fx_tb"),
    "read_tb_unreadable": with_tables("""
select account_code, count(*) filter (where account_code like '%50') as unreadable_rows,
       count(*) filter (where account_code not like '%50') as amounts
from fx_tb where period_code = 'Q1_1997' group by account_code""", "fx_tb"),
    "read_interco": with_tables("""
select company_code, rpt_interco_code, account_code, count(*) as row_count,
       cast(sum(rpt_amount) as double) as amount_sum
from fx_interco group by all""", "fx_interco"),
    "read_coa": with_tables("select * from fx_coa", "fx_coa"),
    "read_fs_group": with_tables("select * exclude (fs_group_id) from fx_fsgroup", "fx_fsgroup"),
    "write_report": statement_sql(f"""
select {FS}, {report_measures('')} from m where {ONE} and account_type in {BS} group by {FS}
union all
select '', '', '', 'Total', {report_measures('')} from m where {ONE} and account_type in {BS}"""),
    "empty_sources": with_tables("""
select period_code, table_name, case table_name
         when 'trial_balance' then exists (select 1 from fx_tb t where t.period_code = p.period_code)
         when 'interco' then exists (select 1 from fx_interco t where t.period_code = p.period_code)
         else exists (select 1 from fx_jheader t where t.period_code = p.period_code) end as found
from (values ('Q1_1997'), ('Q1_2030')) p(period_code)
cross join (values ('trial_balance'), ('interco'), ('journal_header')) n(table_name)""",
                                 "fx_tb", "fx_interco", "fx_jheader"),
    "journals_bucketed": with_tables("""
select h.journal_no, h.company_code, count(*) as line_count, cast(sum(debit) as double) as sum_debit,
       cast(sum(credit) as double) as sum_credit
from fx_jheader h join fx_journal l on h.journal_no = l.journal_no group by h.journal_no, h.company_code""",
                                     "fx_jheader", "fx_journal"),
    "rpt_result_labels": _labelled(rpt_sql(total=True), "rpt_result"),
    "working_bs_labels": _labelled(working_sql(BS, "", total=True), "working"),
    "subscription_report_labels": _labelled(admin_registry.SQL["subscription_report"], "subscription"),
    "user_report_labels": _labelled(admin_registry.SQL["user_report"], "user"),
    "admin_log_report_labels": _labelled(admin_registry.SQL["admin_log_report"], "admin_log"),
}
