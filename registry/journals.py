"""Journal posting, replacement, numbering and lists."""

from pyspark.sql import functions as F

from ledgerfold.operators import journals as jv
from ledgerfold.operators.quality import journal_totals
from ledgerfold.operators.scope import journals_of
from ledgerfold.operators.shaping import first_n
from ledgerfold.plans import listings
from ledgerfold.sources.store import cascade_delete
from registry.inputs import PARENT, PERIOD, books, plain
from registry.tables_sql import with_tables

_HEADER = ["journal_no", "period_code", "parent_company_code", "company_code", "journal_type"]


def _posting(spark, sf, **scope):
    """Journals of the open period are posted anew, onto those of every other period."""
    b = books(spark, sf)
    in_batch = F.col("period_code") == PERIOD
    return jv.post_journals(
        b.journal_batch.where(in_batch).drop("amt"),
        b.journal_line,
        b.journal_header.where(~in_batch),
        "k",
        **scope,
    )


def _post_journals(spark, sf):
    return _posting(spark, sf).headers.select(*_HEADER, "k")


def _post_journals_lines(spark, sf):
    return plain(
        _posting(spark, sf).lines.select(
            "journal_no", "account_code", "debit", "credit", "journal_amount"
        )
    )


def _post_journals_rejected(spark, sf):
    return _posting(spark, sf).rejected.select("k", "reason")


def _post_journals_scoped(spark, sf):
    """As above under the scope rules; the parent comes from the company."""
    b = books(spark, sf)
    posting = _posting(spark, sf, company=b.company, period=b.period, coa=b.coa)
    return posting.rejected.select("k", "reason", "parent_company_code")


def _updated(spark, sf):
    b = books(spark, sf)
    swapped = (
        b.journal_line.join(
            b.journal_header.where(F.col("period_code") == PERIOD).select("journal_no"),
            "journal_no",
            "left_semi",
        )
        .withColumns({"debit": F.col("credit"), "credit": F.col("debit")})
    )
    unknown = swapped.withColumn("journal_no", F.concat("journal_no", F.lit("?")))
    return jv.update_journals(b.journal_line, swapped.unionByName(unknown), b.journal_header)


def _update_journals_lines(spark, sf):
    return plain(
        _updated(spark, sf).select(
            "journal_no", "account_code", "debit", "credit", "journal_amount", "period_code"
        )
    )


def _update_journals(spark, sf):
    return plain(
        _updated(spark, sf)
        .groupBy("account_code")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum("debit").alias("sum_debit"),
            F.sum("credit").alias("sum_credit"),
            F.sum("journal_amount").alias("sum_amount"),
        )
    )


def _cascade_delete(spark, sf):
    b = books(spark, sf)
    gone = b.journal_header.where(F.col("period_code") == PERIOD).select("journal_no")
    headers, lines = cascade_delete(b.journal_header, b.journal_line, gone)
    by_type = headers.groupBy(F.col("journal_type").alias("kind")).agg(
        F.count(F.lit(1)).alias("row_count")
    )
    by_account = lines.groupBy(F.col("account_code").alias("kind")).agg(
        F.count(F.lit(1)).alias("row_count")
    )
    return by_type.unionByName(by_account)


def _number_journals(spark, sf):
    b = books(spark, sf)
    return jv.number_journals(b.journal_header, b.journal_batch, "k").select(
        "journal_no", "parent_company_code", "k"
    )


def _search_journals(spark, sf):
    return listings.journal_summary(
        books(spark, sf), "TakeEq", period_code="q1_", company_code="c1", journal_no="_jv_"
    ).select(*_HEADER)


def _first_n(spark, sf):
    found = journals_of(books(spark, sf).journal_header, "TakeEq", PARENT)
    return first_n(found.select(*_HEADER), ["journal_no"])


QUERIES = {
    "post_journals": _post_journals,
    "post_journals_lines": _post_journals_lines,
    "post_journals_rejected": _post_journals_rejected,
    "post_journals_scoped": _post_journals_scoped,
    "update_journals": _update_journals,
    "update_journals_lines": _update_journals_lines,
    "cascade_delete": _cascade_delete,
    "number_journals": _number_journals,
    "journal_totals": lambda spark, sf: plain(journal_totals(books(spark, sf).journal_line)),
    "journal_summary": lambda spark, sf: listings.journal_summary(
        books(spark, sf), "Reclassify", PARENT
    ).select(*_HEADER),
    "search_journals": _search_journals,
    "journal_detail": lambda spark, sf: plain(listings.journal_detail(books(spark, sf))),
    "first_n": _first_n,
}

_POSTED = """
verdict as (
  select k, sum(coalesce(debit, 0)) - sum(coalesce(credit, 0)) as difference from fx_journal group by k),
last as (
  select parent_company_code, max(cast(split_part(journal_no, '_JV_', 2) as bigint)) as n
  from fx_jheader where period_code <> 'Q1_1997' group by parent_company_code),
posted as (
  select h.parent_company_code || '_JV_' || printf('%05d', coalesce(last.n, 0)
           + row_number() over (partition by h.parent_company_code order by h.k)) as journal_no,
         h.period_code, h.parent_company_code, h.company_code, h.journal_type, h.k
  from fx_jheader h join verdict v on h.k = v.k
  left join last on h.parent_company_code = last.parent_company_code
  where h.period_code = 'Q1_1997' and v.difference = 0)"""

SQL = {
    "post_journals": with_tables(
        f"with {_POSTED.strip()} select * from posted", "fx_jheader", "fx_journal"),
    "post_journals_lines": with_tables(f"""
with {_POSTED.strip()}
select p.journal_no, l.account_code, cast(coalesce(debit, 0) as double) as debit,
       cast(coalesce(credit, 0) as double) as credit,
       cast(coalesce(debit, 0) - coalesce(credit, 0) as double) as journal_amount
from posted p join fx_journal l on p.k = l.k""", "fx_jheader", "fx_journal"),
    "post_journals_rejected": with_tables("""
with verdict as (
  select k, sum(coalesce(debit, 0)) - sum(coalesce(credit, 0)) as difference from fx_journal group by k)
select h.k, 'unbalanced' as reason
from fx_jheader h join verdict v on h.k = v.k
where h.period_code = 'Q1_1997' and v.difference <> 0""", "fx_jheader", "fx_journal"),
    "post_journals_scoped": with_tables("""
with verdict as (
  select h.k, h.parent_company_code, h.company_code, h.period_code,
         sum(coalesce(debit, 0)) - sum(coalesce(credit, 0)) as difference,
         bool_and(a.account_code is not null) as charted
  from fx_jheader h join fx_journal l on h.k = l.k
  left join fx_coa a on a.company_code = h.parent_company_code and a.account_code = l.account_code
  where h.period_code = 'Q1_1997' group by 1, 2, 3, 4)
select k, case when difference <> 0 then 'unbalanced' else 'out_of_scope' end as reason, parent_company_code
from verdict v
where difference <> 0 or not charted or not exists (
  select 1 from fx_period p where p.period_status = 'Open' and p.company_code = v.parent_company_code
                             and p.period_code = v.period_code)""",
                                        "fx_jheader", "fx_journal", "fx_coa", "fx_period"),
    "update_journals": with_tables("""
with swapped as (
  select h.k from fx_jheader h join fx_journal l on h.k = l.k where h.period_code = 'Q1_1997'
  group by h.k having sum(coalesce(debit, 0)) = sum(coalesce(credit, 0))),
now as (
  select account_code, case when s.k is null then debit else coalesce(credit, 0) end as debit,
         case when s.k is null then credit else coalesce(debit, 0) end as credit
  from fx_journal l left join swapped s on l.k = s.k)
select account_code, count(*) as row_count, cast(sum(debit) as double) as sum_debit,
       cast(sum(credit) as double) as sum_credit,
       cast(sum(coalesce(debit, 0) - coalesce(credit, 0)) as double) as sum_amount
from now group by account_code""", "fx_jheader", "fx_journal"),
    "update_journals_lines": with_tables("""
with swapped as (
  select h.k from fx_jheader h join fx_journal l on h.k = l.k where h.period_code = 'Q1_1997'
  group by h.k having sum(coalesce(debit, 0)) = sum(coalesce(credit, 0)))
select l.journal_no, l.account_code,
       cast(case when s.k is null then debit else coalesce(credit, 0) end as double) as debit,
       cast(case when s.k is null then credit else coalesce(debit, 0) end as double) as credit,
       cast(case when s.k is null then coalesce(debit, 0) - coalesce(credit, 0)
                 else coalesce(credit, 0) - coalesce(debit, 0) end as double) as journal_amount,
       h.period_code
from fx_journal l join fx_jheader h on l.k = h.k left join swapped s on l.k = s.k""",
                                         "fx_jheader", "fx_journal"),
    "cascade_delete": with_tables("""
select journal_type as kind, count(*) as row_count from fx_jheader where period_code <> 'Q1_1997'
group by journal_type
union all
select l.account_code, count(*) from fx_jheader h join fx_journal l on h.journal_no = l.journal_no
where h.period_code <> 'Q1_1997' group by l.account_code""", "fx_jheader", "fx_journal"),
    "number_journals": with_tables("""
select parent_company_code || '_JV_' || printf('%05d', max(k) over (partition by parent_company_code)
         + row_number() over (partition by parent_company_code order by k)) as journal_no,
       parent_company_code, k
from fx_jheader""", "fx_jheader"),
    "journal_totals": with_tables("""
select journal_no, cast(sum(coalesce(debit, 0)) as double) as sum_debit,
       cast(sum(coalesce(credit, 0)) as double) as sum_credit
from fx_journal group by journal_no""", "fx_journal"),
    "journal_summary": with_tables("""
select journal_no, period_code, parent_company_code, company_code, journal_type from fx_jheader
where journal_type = 'Reclassify' and parent_company_code = 'C00'""", "fx_jheader"),
    "search_journals": with_tables("""
select journal_no, period_code, parent_company_code, company_code, journal_type from fx_jheader
where journal_type = 'TakeEq' and contains(lower(period_code), 'q1_') and contains(lower(company_code), 'c1')""",
                                   "fx_jheader"),
    "journal_detail": with_tables("""
select l.journal_no, l.account_code, cast(coalesce(l.debit, 0) as double) as debit,
       cast(coalesce(l.credit, 0) as double) as credit, h.period_code, h.company_code, h.journal_type,
       cast(t.sum_debit as double) as sum_debit, cast(t.sum_credit as double) as sum_credit
from fx_journal l join fx_jheader h on l.journal_no = h.journal_no
join (select journal_no, sum(coalesce(debit, 0)) as sum_debit, sum(coalesce(credit, 0)) as sum_credit
      from fx_journal group by journal_no) t on l.journal_no = t.journal_no""", "fx_jheader", "fx_journal"),
    "first_n": with_tables("""
select journal_no, period_code, parent_company_code, company_code, journal_type from fx_jheader
where journal_type = 'TakeEq' and parent_company_code = 'C00' order by journal_no limit 10""", "fx_jheader"),
}
