"""Load gates, replacement, lookups and data-quality rules."""

from pyspark.sql import functions as F

from ledgerfold.functions import clean_file_name
from ledgerfold.operators import quality
from ledgerfold.operators.scope import in_period, scope
from ledgerfold.plans import listings
from ledgerfold.schemas import EXPENSE, MONEY
from ledgerfold.sources import gates, lookups, store
from ledgerfold.sources.files import INVALID_FORMAT, Upload
from registry.inputs import PARENT, PERIOD, books, plain
from registry.tables_sql import with_tables

_PUNCTUATION = "!@#$%^&*''()[]{};:,/<>?\\|`~=+"
_UNDERSCORES = "_" * (len(_PUNCTUATION) - 1)

_OPEN_ROW = """
exists (select 1 from fx_period p where p.period_status = 'Open' and p.period_code = t.period_code
        and (p.company_code = t.company_code or p.company_code = c.parent_company))"""


def _zero_sum_gate(spark, sf):
    return plain(gates.zero_sum_gate(books(spark, sf).trial_balance))


def _zero_sum_gate_uploads(spark, sf):
    return plain(gates.zero_sum_gate(books(spark, sf).upload, "raw_file_name"))


def _period_gate(spark, sf):
    b = books(spark, sf)
    return gates.period_gate(b.trial_balance, b.period, b.company, "tb_file_name")


def _period_gate_uploads(spark, sf):
    b = books(spark, sf)
    return gates.period_gate(b.upload, b.period, b.company, "raw_file_name")


def _clean_file_name(spark, sf):
    return (
        books(spark, sf)
        .upload.groupBy("raw_file_name", clean_file_name("raw_file_name").alias("file_name"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def _per_file(df, file_column="tb_file_name", amount="tb_amount"):
    return plain(
        df.groupBy(file_column).agg(
            F.count(F.lit(1)).alias("row_count"), F.sum(amount).alias("amount_sum")
        )
    )


def _replace_by_file(spark, sf):
    tb = books(spark, sf).trial_balance
    again = tb.where(F.col("period_code") == PERIOD).withColumn(
        "tb_amount", (F.col("tb_amount") * 2).cast(MONEY)
    )
    return _per_file(store.replace_by_file(tb, again, "tb_file_name"))


def _delete_by_file(spark, sf):
    tb = books(spark, sf).trial_balance
    return _per_file(
        store.delete_by_key(tb, tb.where(F.col("period_code") == PERIOD).select("tb_file_name"))
    )


def _append_batch(spark, sf):
    b = books(spark, sf)
    batch = b.interco.select(
        "company_code", "period_code", "account_code", F.col("rpt_amount").alias("tb_amount")
    )
    return _per_file(store.append(b.trial_balance, batch))


def _scope_tb(spark, sf):
    b = books(spark, sf)
    return _per_file(in_period(scope(b.trial_balance, b.company, PARENT), PERIOD), "account_code")


def _cascade_delete_groups(spark, sf):
    b = books(spark, sf)
    gone = b.fs_group.where(F.col("account_type") == EXPENSE).select("fs_group_id")
    groups, accounts = store.cascade_delete(b.fs_group, b.coa, gone, "fs_group")
    kept = groups.select("company_code", F.lit("group").alias("kind"))
    return (
        kept.unionByName(accounts.select("company_code", F.lit("account").alias("kind")))
        .groupBy("company_code", "kind")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def _insert_if_absent(spark, sf):
    b = books(spark, sf)
    keys = ["company_code", "period_code", "account_code", "tb_amount"]
    batch = b.interco.withColumnRenamed("rpt_amount", "tb_amount").select(*keys)
    return plain(
        store.insert_if_absent(b.trial_balance.select(*keys), batch, keys)
        .groupBy("company_code", "period_code")
        .agg(F.count(F.lit(1)).alias("row_count"), F.sum("tb_amount").alias("amount_sum"))
    )


def doubled_upload(df, name, file_column, amount):
    """Stored rows as new files: doubled; a unit too much in each row of companies C.3; and
    the files of companies C.7 turned away for their header."""
    company = F.col("company_code")
    rows = df.withColumns(
        {
            "file_name": F.concat(F.lit(name), "company_code", F.lit("]"), "period_code", F.lit(".xlsx")),
            amount: F.when(company.endswith("3"), F.col(amount) + 1)
            .otherwise(F.col(amount) * 2)
            .cast(MONEY),
        }
    ).drop(file_column)
    bad = company.endswith("7")
    rejected = rows.where(bad).select("file_name", F.lit(INVALID_FORMAT).alias("reason")).distinct()
    return Upload(rows.where(~bad), rejected)


def _tb_load(spark, sf):
    b = books(spark, sf)
    return store.import_tb(b, doubled_upload(b.trial_balance, "TB[", "tb_file_name", "tb_amount"))


def _interco_load(spark, sf):
    b = books(spark, sf)
    return store.import_interco(b, doubled_upload(b.interco, "RPT[", "rpt_file_name", "rpt_amount"))


def _import_tb(spark, sf):
    return plain(
        _tb_load(spark, sf)
        .table.groupBy("tb_file_name")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum("tb_amount").alias("amount_sum"),
            F.sum(F.abs("tb_amount")).alias("absolute_sum"),
        )
    )


def _import_tb_files(spark, sf):
    return plain(_tb_load(spark, sf).files)


def _import_tb_rejected(spark, sf):
    files = _tb_load(spark, sf).files.where(F.col("reason").isNotNull())
    return files.groupBy("reason").agg(F.count(F.lit(1)).alias("file_count"))


def _import_interco_files(spark, sf):
    return plain(_interco_load(spark, sf).files)


def _delete_named_file(spark, sf):
    tb = books(spark, sf).trial_balance
    return _per_file(store.delete_file(tb, "tb_file_name", f"TB_{PARENT}_{PERIOD}.xlsx"))


def _upload_summary_rpt(spark, sf):
    b = books(spark, sf)
    stamped = b.interco.withColumn(
        "rpt_date_create", F.lit("2024-01-15 10:20:30").cast("timestamp_ntz")
    )
    return plain(
        listings.upload_summary(stamped, "rpt_file_name", "rpt_amount", "rpt_date_create")
    )


def _resolve_codes(spark, sf):
    b = books(spark, sf)
    resolved = lookups.resolve_codes(
        b.interco,
        {
            "period": (b.period, ["company_code", "period_code"]),
            "company": (b.company, ["company_code"]),
            "account": (b.coa, ["company_code", "account_code"]),
        },
    )
    return plain(
        resolved.groupBy("company_code", "account_code", "unresolved").agg(
            F.count(F.lit(1)).alias("row_count"), F.sum("rpt_amount").alias("amount_sum")
        )
    )


def _lookup_account(spark, sf):
    b = books(spark, sf)
    number = F.expr("(cast(account_code as int) - 1000) div 10")
    typed = (
        b.trial_balance.groupBy("company_code", "account_code")
        .agg(F.sum("tb_amount").alias("amount_sum"))
        .withColumns(
            {
                "account_name": F.concat(F.lit("ACCOUNT "), number),
                "wk_group_row": F.format_string(
                    "w%02d", F.expr("(((cast(account_code as int) - 1000) div 10) - 1) div 2")
                ),
            }
        )
    )
    return plain(lookups.lookup_account(b.coa, typed))


def _check_one_open(spark, sf):
    period = books(spark, sf).period
    reopened = F.col("period_code").endswith("_1997") & F.col("company_code").endswith("0")
    return quality.check_one_open(
        period.withColumn(
            "period_status", F.when(reopened, "Open").otherwise(F.col("period_status"))
        )
    )


def _check_unique(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return quality.check_unique(lines, ["l_orderkey", "l_linenumber"])


def _check_orphans_coa(spark, sf):
    b = books(spark, sf)
    return quality.check_orphans(b.coa, b.fs_group, {"fs_group": "fs_group_id"})


def _check_orphans_subscription(spark, sf):
    b = books(spark, sf)
    return quality.check_orphans(b.subscription, b.plan, ["plan_code"])


def _check_orphans_log(spark, sf):
    b = books(spark, sf)
    return quality.check_orphans(b.admin_log, b.content_type, ["content_type_id"]).select(
        "id", "content_type_id", "user_id"
    )


def _check_domain(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return quality.check_domain(events, "event_type", ["view", "click", "purchase"]).select(
        "event_id", "event_type"
    )


def _check_range(spark, sf):
    broken = quality.check_range(books(spark, sf).trial_balance, ["tb_amount"])
    return plain(
        broken.groupBy("company_code", "period_code").agg(
            F.count(F.lit(1)).alias("row_count"), F.sum("tb_amount").alias("amount_sum")
        )
    )


def _check_required_subscription(spark, sf):
    return quality.check_required(books(spark, sf).subscription, ["company_code", "end_date"])


def _check_required_company(spark, sf):
    return quality.check_required(
        books(spark, sf).company.select("company_code", "company_name"),
        ["company_code"],
        {"company_code": 5, "company_name": 8},
    )


def _check_balanced(spark, sf):
    return plain(quality.check_balanced(books(spark, sf).journal_line))


def _check_journal_scope(spark, sf):
    b = books(spark, sf)
    return quality.check_journal_scope(
        b.journal_header, b.journal_line, b.period, b.company, b.coa
    )


QUERIES = {
    "zero_sum_gate": _zero_sum_gate,
    "zero_sum_gate_uploads": _zero_sum_gate_uploads,
    "period_gate": _period_gate,
    "period_gate_uploads": _period_gate_uploads,
    "clean_file_name": _clean_file_name,
    "replace_by_file": _replace_by_file,
    "delete_by_file": _delete_by_file,
    "append_batch": _append_batch,
    "scope_tb": _scope_tb,
    "cascade_delete_groups": _cascade_delete_groups,
    "insert_if_absent": _insert_if_absent,
    "import_tb": _import_tb,
    "import_tb_files": _import_tb_files,
    "import_tb_rejected": _import_tb_rejected,
    "delete_named_file": _delete_named_file,
    "upload_summary_rpt": _upload_summary_rpt,
    "import_interco_files": _import_interco_files,
    "resolve_codes": _resolve_codes,
    "lookup_account": _lookup_account,
    "upload_summary": lambda spark, sf: plain(
        listings.upload_summary(books(spark, sf).upload, "raw_file_name")
    ),
    "file_rows": lambda spark, sf: listings.file_rows(books(spark, sf).upload, "raw_file_name"),
    "check_unique": _check_unique,
    "check_one_open": _check_one_open,
    "check_orphans": _check_orphans_coa,
    "check_orphans_subscription": _check_orphans_subscription,
    "check_orphans_log": _check_orphans_log,
    "check_domain": _check_domain,
    "check_range": _check_range,
    "check_required": _check_required_subscription,
    "check_required_length": _check_required_company,
    "check_balanced": _check_balanced,
    "check_journal_scope": _check_journal_scope,
}

_VERDICTS = """
uploaded as (
  select t.company_code, t.period_code,
         case when t.company_code like '%3' then {amount} + 1 else 2 * {amount} end as amount,
         {open} as is_open
  from {table} t left join fx_company c on t.company_code = c.company_code),
v as (
  select '{name}_' || company_code || '_' || period_code || '.xlsx' as {column},
         case when company_code not like '%7' then count(*) end as file_rows,
         case when company_code not like '%7' then cast(sum(amount) as double) end as file_total,
         case when company_code like '%7' then 'bad_header' when not bool_and(is_open) then 'period_not_open'
              {zero} end as reason
  from uploaded group by company_code, period_code)"""
TB_VERDICTS = "with " + _VERDICTS.strip().format(
    amount="t.tb_amount", open=_OPEN_ROW, table="fx_tb", name="TB", column="tb_file_name",
    zero="when sum(amount) <> 0 then 'not_zero_sum'")
_RPT_VERDICTS = "with " + _VERDICTS.strip().format(
    amount="t.rpt_amount", open=_OPEN_ROW, table="fx_interco", name="RPT", column="rpt_file_name", zero="")

SQL = {
    "zero_sum_gate": with_tables("""
select tb_file_name, cast(sum(tb_amount) as double) as file_total, sum(tb_amount) = 0 as accepted
from fx_tb group by tb_file_name""", "fx_tb"),
    "zero_sum_gate_uploads": with_tables("""
select raw_file_name, cast(sum(tb_amount) as double) as file_total, sum(tb_amount) = 0 as accepted
from fx_upload group by raw_file_name""", "fx_upload"),
    "period_gate": with_tables(f"""
select tb_file_name, count(*) as file_rows, count(*) filter (where not is_open) as closed_rows,
       bool_and(is_open) as accepted
from (select t.tb_file_name, {_OPEN_ROW} as is_open
      from fx_tb t left join fx_company c on t.company_code = c.company_code)
group by tb_file_name""", "fx_tb", "fx_period", "fx_company"),
    "period_gate_uploads": with_tables(f"""
select raw_file_name, count(*) as file_rows, count(*) filter (where not is_open) as closed_rows,
       bool_and(is_open) as accepted
from (select t.raw_file_name, {_OPEN_ROW} as is_open
      from fx_upload t left join fx_company c on t.company_code = c.company_code)
group by raw_file_name""", "fx_upload", "fx_period", "fx_company"),
    "clean_file_name": with_tables(f"""
select raw_file_name, translate(raw_file_name, '{_PUNCTUATION}', '{_UNDERSCORES}') as file_name,
       count(*) as row_count
from fx_upload group by raw_file_name""", "fx_upload"),
    "replace_by_file": with_tables("""
select tb_file_name, count(*) as row_count,
       cast(sum(case when period_code = 'Q1_1997' then 2 * tb_amount else tb_amount end) as double) as amount_sum
from fx_tb group by tb_file_name""", "fx_tb"),
    "delete_by_file": with_tables("""
select tb_file_name, count(*) as row_count, cast(sum(tb_amount) as double) as amount_sum
from fx_tb where period_code <> 'Q1_1997' group by tb_file_name""", "fx_tb"),
    "append_batch": with_tables("""
select tb_file_name, count(*) as row_count, cast(sum(tb_amount) as double) as amount_sum
from (select tb_file_name, tb_amount from fx_tb union all select null, rpt_amount from fx_interco)
group by tb_file_name""", "fx_tb", "fx_interco"),
    "scope_tb": with_tables("""
select account_code, count(*) as row_count, cast(sum(tb_amount) as double) as amount_sum
from fx_tb where period_code = 'Q1_1997'
  and company_code in (select company_code from fx_company where parent_company = 'C00')
group by account_code""", "fx_tb", "fx_company"),
    "cascade_delete_groups": with_tables("""
select company_code, 'group' as kind, count(*) as row_count from fx_fsgroup
where account_type <> 'ค่าใช้จ่าย' group by company_code
union all
select company_code, 'account', count(*) from fx_coa
where fs_group not in (select fs_group_id from fx_fsgroup where account_type = 'ค่าใช้จ่าย')
group by company_code""", "fx_fsgroup", "fx_coa"),
    "insert_if_absent": with_tables("""
with added as (
  select distinct company_code, period_code, account_code, rpt_amount as tb_amount from fx_interco
  except
  select company_code, period_code, account_code, tb_amount from fx_tb)
select company_code, period_code, count(*) as row_count, cast(sum(tb_amount) as double) as amount_sum
from (select company_code, period_code, account_code, tb_amount from fx_tb
      union all select company_code, period_code, account_code, tb_amount from added)
group by company_code, period_code""", "fx_tb", "fx_interco"),
    "import_tb": with_tables(TB_VERDICTS + """,
now as (
  select t.tb_file_name, case when v.reason is null then 2 * t.tb_amount else t.tb_amount end as tb_amount
  from fx_tb t join v on t.tb_file_name = v.tb_file_name)
select tb_file_name, count(*) as row_count, cast(sum(tb_amount) as double) as amount_sum,
       cast(sum(abs(tb_amount)) as double) as absolute_sum
from now group by tb_file_name""", "fx_tb", "fx_period", "fx_company"),
    "import_tb_files": with_tables(TB_VERDICTS + " select * from v", "fx_tb", "fx_period", "fx_company"),
    "import_tb_rejected": with_tables(TB_VERDICTS + """
select reason, count(*) as file_count from v where reason is not null group by reason""",
                                      "fx_tb", "fx_period", "fx_company"),
    "import_interco_files": with_tables(
        _RPT_VERDICTS + " select * from v", "fx_interco", "fx_period", "fx_company"),
    "delete_named_file": with_tables("""
select tb_file_name, count(*) as row_count, cast(sum(tb_amount) as double) as amount_sum
from fx_tb where tb_file_name <> 'TB_C00_Q1_1997.xlsx' group by tb_file_name""", "fx_tb"),
    "upload_summary_rpt": with_tables("""
select company_code, period_code, timestamp '2024-01-15 10:20:00' as date_create, rpt_file_name,
       cast(sum(rpt_amount) as double) as amount_sum, '15 Jan 2024 10:20' as date_label
from fx_interco group by all""", "fx_interco"),
    "resolve_codes": with_tables("""
select i.company_code, i.account_code,
       concat_ws(',', case when p.company_code is null then 'period' end,
                 case when c.company_code is null then 'company' end,
                 case when a.account_code is null then 'account' end) as unresolved,
       count(*) as row_count, cast(sum(rpt_amount) as double) as amount_sum
from fx_interco i
left join fx_period p on i.company_code = p.company_code and i.period_code = p.period_code
left join fx_company c on i.company_code = c.company_code
left join fx_coa a on i.company_code = a.company_code and i.account_code = a.account_code
group by 1, 2, 3""", "fx_interco", "fx_period", "fx_company", "fx_coa"),
    "lookup_account": with_tables("""
with typed as (
  select company_code, account_code, cast(sum(tb_amount) as double) as amount_sum,
         'ACCOUNT ' || cast((cast(account_code as int) - 1000) // 10 as string) as account_name,
         printf('w%02d', ((cast(account_code as int) - 1000) // 10 - 1) // 2) as wk_group_row
  from fx_tb group by company_code, account_code)
select t.company_code, t.account_code, t.amount_sum, t.account_name, t.wk_group_row,
       a.account_code as matched_account
from typed t
left join fx_coa a on t.company_code = a.company_code and lower(t.account_code) = lower(a.account_code)
  and lower(t.account_name) = lower(a.account_name) and lower(t.wk_group_row) = lower(a.wk_group_row)""",
                                  "fx_tb", "fx_coa"),
    "upload_summary": with_tables("""
select company_code, period_code, date_trunc('minute', tb_date_create) as date_create, raw_file_name,
       cast(sum(tb_amount) as double) as amount_sum,
       strftime(date_trunc('minute', tb_date_create), '%-d %b %Y %H:%M') as date_label
from fx_upload group by all""", "fx_upload"),
    "file_rows": with_tables(f"""
select translate(raw_file_name, '{_PUNCTUATION}', '{_UNDERSCORES}') as raw_file_name, count(*) as row_count
from fx_upload group by 1""", "fx_upload"),
    "check_unique": """
select l_orderkey, l_linenumber, count(*) as row_count from lineitem
where l_orderkey is not null and l_linenumber is not null
group by l_orderkey, l_linenumber having count(*) > 1""",
    "check_one_open": with_tables("""
select company_code, count(*) as open_periods from fx_period
where period_status = 'Open' or (period_code like '%1997' and company_code like '%0')
group by company_code having count(*) > 1""", "fx_period"),
    "check_orphans": with_tables("""
select * from fx_coa where fs_group not in (select fs_group_id from fx_fsgroup)""", "fx_coa", "fx_fsgroup"),
    "check_orphans_subscription": with_tables("""
select * from fx_subscription where plan_code not in (select plan_code from fx_plan)""",
                                              "fx_subscription", "fx_plan"),
    "check_orphans_log": with_tables("""
select id, content_type_id, user_id from fx_admin_log
where content_type_id not in (select content_type_id from fx_content_type)""", "fx_admin_log", "fx_content_type"),
    "check_domain": """
select event_id, event_type from events where event_type not in ('view', 'click', 'purchase')""",
    "check_range": with_tables("""
select company_code, period_code, count(*) as row_count, cast(sum(tb_amount) as double) as amount_sum
from fx_tb where tb_amount < 0 or abs(tb_amount) >= 10000000000000
group by company_code, period_code""", "fx_tb"),
    "check_required": with_tables("""
select *, 'end_date' as faults from fx_subscription where end_date is null""", "fx_subscription"),
    "check_required_length": with_tables("""
select company_code, company_name, 'company_name' as faults from fx_company where length(company_name) > 8""",
                                         "fx_company"),
    "check_balanced": with_tables("""
select journal_no, cast(sum(coalesce(debit, 0)) as double) as sum_debit,
       cast(sum(coalesce(credit, 0)) as double) as sum_credit,
       cast(sum(coalesce(debit, 0)) - sum(coalesce(credit, 0)) as double) as difference
from fx_journal group by journal_no having sum(coalesce(debit, 0)) <> sum(coalesce(credit, 0))""",
                                  "fx_journal"),
    "check_journal_scope": with_tables("""
select journal_no, 'period_code' as rule, period_code as value from fx_jheader h
where not exists (select 1 from fx_period p where p.period_status = 'Open'
                  and p.company_code = h.parent_company_code and p.period_code = h.period_code)
union all
select journal_no, 'company_code', company_code from fx_jheader h
where not exists (select 1 from fx_company c where c.parent_company = h.parent_company_code
                  and c.company_code = h.company_code)
union all
select distinct h.journal_no, 'account_code', l.account_code
from fx_jheader h join fx_journal l on h.journal_no = l.journal_no
where not exists (select 1 from fx_coa a where a.company_code = h.parent_company_code
                  and a.account_code = l.account_code)""",
                                       "fx_jheader", "fx_journal", "fx_period", "fx_company", "fx_coa"),
}
