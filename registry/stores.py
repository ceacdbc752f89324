"""Stored books: the ledger of files, changes as a whole, and reports from kept sums."""

from datetime import datetime

from pyspark.sql import functions as F

from ledgerfold.plans import bookkeeping as bk
from ledgerfold.plans import statements as st
from ledgerfold.session import scratch
from ledgerfold.sources.books import Books
from ledgerfold.sources.files import Upload
from ledgerfold.sources.generations import Store
from ledgerfold.sources.store import INTERCO, TRIAL_BALANCE
from registry.inputs import PARENT, PERIOD, books, plain
from registry.loads import TB_VERDICTS, doubled_upload
from registry.statements import BS, FS, MAPPED, PL, report_measures
from registry.tables_sql import with_tables

LOADED = datetime(2024, 1, 15, 10, 20, 30)
MOVED_FROM = "Q4_1996"
DELETED = "RPT_C05_Q1_1997.xlsx"


def kept_books(spark, sf):
    """The derived tables, their joins made once for all steps of a query."""
    return books(spark, sf).kept(scratch(spark, "kept"))


def stored(spark, b) -> Store:
    """All facts in a new store, but for the journals of the open period."""
    store = Store.create(spark, scratch(spark, "books"))
    later = F.col("period_code") == PERIOD
    bk.store_books(
        store,
        Books(
            company=b.company,
            period=b.period,
            coa=b.coa,
            fs_group=b.fs_group,
            trial_balance=b.trial_balance,
            interco=b.interco,
            journal_header=b.journal_header.where(~later),
            journal_line=b.journal_line.where(~later),
        ),
    )
    return store


def _import(store, b):
    upload = doubled_upload(b.trial_balance, "TB[", "tb_file_name", "tb_amount")
    return bk.import_files(store, b, upload, TRIAL_BALANCE, LOADED)


def _post(store, b):
    batch = b.journal_batch.where(F.col("period_code") == PERIOD).drop("amt")
    return bk.post_batch(store, b, batch, b.journal_line, "k", f"journals of {PERIOD}")


def _import_ledger(spark, sf):
    """The ledger after the same upload came twice: the second time nothing is written."""
    b = kept_books(spark, sf)
    store = stored(spark, b)
    _import(store, b)
    _import(store, b)
    return store.files("trial_balance").select(
        F.col("file_name").alias("tb_file_name"), F.inline("periods"), "version"
    ).drop("digest")


def _import_moved_files(spark, sf):
    """All files of one period come again for another, so that the first is emptied."""
    b = kept_books(spark, sf)
    store = stored(spark, b)
    moved = b.trial_balance.where(F.col("period_code") == MOVED_FROM).withColumn(
        "period_code", F.lit(PERIOD)
    )
    upload = Upload(moved.withColumnRenamed("tb_file_name", "file_name"), None)
    bk.import_files(store, b, upload, TRIAL_BALANCE, LOADED)
    return plain(
        store.table("trial_balance")
        .groupBy("tb_file_name", "period_code")
        .agg(F.count(F.lit(1)).alias("row_count"), F.sum("tb_amount").alias("amount_sum"))
    )


def _post_journals_again(spark, sf):
    """A batch posted twice under one key is stored once, with numbers after the marks."""
    b = kept_books(spark, sf)
    store = stored(spark, b)
    _post(store, b)
    _post(store, b)
    return (
        store.table("journal_header")
        .where(F.col("period_code") == PERIOD)
        .select("journal_no", "parent_company_code", "company_code", "journal_type", "journal_description")
    )


def _series(spark, sf):
    """An import, a deletion and a posting, one after the other."""
    b = kept_books(spark, sf)
    store = stored(spark, b)
    _import(store, b)
    bk.delete_files(store, b, INTERCO, DELETED)
    _post(store, b)
    return store.books(b)


def _maintained(statement, parent=None, period=None):
    def query(spark, sf):
        kept = _series(spark, sf)
        fact = bk.kept_fact(kept, parent, period)
        return plain(st.report(kept, parent, period, statement, fact=fact))

    return query


def _journal_changes(spark, sf):
    """Stored journals of one period with debit and credit exchanged, some of another deleted."""
    b = kept_books(spark, sf)
    store = stored(spark, b)
    lines = store.table("journal_line").where(F.col("period_code") == "Q4_1996").drop("period_code")
    exchanged = lines.withColumns({"debit": F.col("credit"), "credit": F.col("debit")})
    bk.replace_lines(store, b, exchanged)
    gone = store.table("journal_header").where(
        (F.col("period_code") == "Q3_1996") & F.col("journal_no").endswith("1")
    )
    bk.delete_journals(store, b, gone)
    return plain(
        store.table("account_fact")
        .where(F.col("source").isin("recl", "te"))
        .groupBy("period_code", "company_code", "source")
        .agg(F.sum("amount").alias("amount"), F.sum(F.abs("amount")).alias("absolute"))
    )


QUERIES = {
    "journal_changes_stored": _journal_changes,
    "import_ledger": _import_ledger,
    "import_moved_files": _import_moved_files,
    "post_journals_again": _post_journals_again,
    "report_bs_maintained": _maintained("bs", PARENT, PERIOD),
    "report_pl_maintained_all": _maintained("pl"),
}

_NOW = """
balance as (
  select journal_no, sum(coalesce(debit, 0)) - sum(coalesce(credit, 0)) as difference
  from fx_journal group by journal_no),
x as (
  select t.company_code, t.period_code, t.account_code,
         case when v.reason is null then 2 * t.tb_amount else t.tb_amount end as tb,
         0.00 as rpt, 0.00 as recl, 0.00 as te
  from fx_tb t join v on t.tb_file_name = v.tb_file_name
  union all
  select company_code, period_code, account_code, 0.00, rpt_amount, 0.00, 0.00 from fx_interco
  where rpt_file_name <> 'RPT_C05_Q1_1997.xlsx'
  union all
  select h.company_code, h.period_code, l.account_code, 0.00, 0.00,
         case when h.journal_type = 'Reclassify' then coalesce(debit, 0) - coalesce(credit, 0) else 0 end,
         case when h.journal_type = 'TakeEq' then coalesce(debit, 0) - coalesce(credit, 0) else 0 end
  from fx_jheader h join fx_journal l on h.journal_no = l.journal_no
  join balance b on h.journal_no = b.journal_no
  where h.period_code <> 'Q1_1997' or difference = 0)"""
_NOW_TABLES = (
    "fx_company", "fx_coa", "fx_fsgroup", "fx_tb", "fx_interco", "fx_jheader", "fx_journal", "fx_period")
_ONE = "parent_company = 'C00' and period_code = 'Q1_1997'"


def _now(select: str) -> str:
    return with_tables(f"{TB_VERDICTS},{_NOW},\n{MAPPED}\n{select.strip()}", *_NOW_TABLES)


SQL = {
    "journal_changes_stored": with_tables("""
with balance as (
  select journal_no, sum(coalesce(debit, 0)) - sum(coalesce(credit, 0)) as difference
  from fx_journal group by journal_no),
now as (
  select h.period_code, h.company_code, l.account_code,
         case when h.journal_type = 'Reclassify' then 'recl' else 'te' end as source,
         case when h.period_code = 'Q4_1996' and difference = 0
              then coalesce(credit, 0) - coalesce(debit, 0)
              else coalesce(debit, 0) - coalesce(credit, 0) end as amount
  from fx_jheader h join fx_journal l on h.journal_no = l.journal_no
  join balance b on h.journal_no = b.journal_no
  where h.period_code <> 'Q1_1997' and not (h.period_code = 'Q3_1996' and h.journal_no like '%1')),
summed as (
  select period_code, company_code, account_code, source, sum(amount) as amount from now group by all)
select period_code, company_code, source, cast(sum(amount) as double) as amount,
       cast(sum(abs(amount)) as double) as absolute
from summed group by period_code, company_code, source""", "fx_jheader", "fx_journal"),
    "import_ledger": with_tables(TB_VERDICTS + """
select t.tb_file_name, t.period_code, count(*) as file_rows,
       cast(case when any_value(v.reason) is null then 2 else 1 end as bigint) as version
from fx_tb t join v on t.tb_file_name = v.tb_file_name group by t.tb_file_name, t.period_code""",
                                 "fx_tb", "fx_period", "fx_company"),
    "import_moved_files": with_tables("""
select tb_file_name, case when period_code = 'Q4_1996' then 'Q1_1997' else period_code end as period_code,
       count(*) as row_count, cast(sum(tb_amount) as double) as amount_sum
from fx_tb group by 1, 2""", "fx_tb"),
    "post_journals_again": with_tables("""
with verdict as (
  select k, sum(coalesce(debit, 0)) - sum(coalesce(credit, 0)) as difference from fx_journal group by k),
last as (
  select parent_company_code, max(cast(split_part(journal_no, '_JV_', 2) as bigint)) as n
  from fx_jheader where period_code <> 'Q1_1997' group by parent_company_code)
select h.parent_company_code || '_JV_' || printf('%05d', coalesce(last.n, 0)
         + row_number() over (partition by h.parent_company_code order by h.k)) as journal_no,
       h.parent_company_code, h.company_code, h.journal_type, h.journal_description
from fx_jheader h join verdict v on h.k = v.k
left join last on h.parent_company_code = last.parent_company_code
where h.period_code = 'Q1_1997' and v.difference = 0""", "fx_jheader", "fx_journal"),
    "report_bs_maintained": _now(f"""
select {FS}, {report_measures('')} from m where {_ONE} and account_type in {BS} group by {FS}
union all
select '', '', '', 'Total', {report_measures('')} from m where {_ONE} and account_type in {BS}"""),
    "report_pl_maintained_all": _now(f"""
select parent_company, period_code, {FS}, {report_measures('-')} from m
where account_type in {PL} group by parent_company, period_code, {FS}
union all
select parent_company, period_code, '', '', '', 'Total', {report_measures('-')} from m
where account_type in {PL} group by parent_company, period_code"""),
}
