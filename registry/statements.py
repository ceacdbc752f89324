"""Reports R1-R5 and the operators they are made of."""

from pyspark.sql import functions as F

from ledgerfold.functions import journal_amount, money_text
from ledgerfold.operators import facts, mapping, shaping
from ledgerfold.operators.scope import companies_under, scope
from ledgerfold.plans import statements as st
from ledgerfold.schemas import LABELS, UNMAPPED
from registry.inputs import COMPANY_CODES, GROUP_CODES, PARENT, PERIOD, books, plain
from registry.tables_sql import with_tables

BS = "('สินทรัพย์', 'หนี้สิน', 'ส่วนของผู้ถือหุ้น', 'n/a group')"
PL = "('รายได้', 'ค่าใช้จ่าย')"

# Long fact and its mapping, as plain SQL.
_MAPPED = """
x as (
  select company_code, period_code, account_code, tb_amount as tb, 0.00 as rpt, 0.00 as recl, 0.00 as te
  from fx_tb
  union all
  select company_code, period_code, account_code, 0.00, rpt_amount, 0.00, 0.00 from fx_interco
  union all
  select h.company_code, h.period_code, l.account_code, 0.00, 0.00,
         case when h.journal_type = 'Reclassify' then coalesce(debit, 0) - coalesce(credit, 0) else 0 end,
         case when h.journal_type = 'TakeEq' then coalesce(debit, 0) - coalesce(credit, 0) else 0 end
  from fx_jheader h join fx_journal l on h.journal_no = l.journal_no),
m as (
  select x.*, c.parent_company, a.account_name,
         coalesce(a.wk_group_row, 'n/a group') as wk_group_row,
         coalesce(g.wk_group_name, 'n/a group') as wk_group_name,
         coalesce(g.fs_group_row, 'n/a group') as fs_group_row,
         coalesce(g.fs_group_name, 'n/a group') as fs_group_name,
         coalesce(g.account_type, 'n/a group') as account_type,
         coalesce(g.account_subtype, 'n/a group') as account_subtype
  from x
  join fx_company c on x.company_code = c.company_code
  left join fx_coa a on a.company_code = x.company_code and a.account_code = x.account_code
  left join fx_fsgroup g on g.company_code = c.parent_company and g.wk_group_row = a.wk_group_row)"""

#: The mapping alone, of any long fact `x`.
MAPPED = _MAPPED[_MAPPED.index("m as (") :]

_FACT_TABLES = ("fx_company", "fx_coa", "fx_fsgroup", "fx_tb", "fx_interco", "fx_jheader", "fx_journal")
WK = "account_type, account_subtype, wk_group_row, wk_group_name"
FS = "account_type, account_subtype, fs_group_row, fs_group_name"
ONE = "parent_company = 'C00' and period_code = 'Q1_1997'"


def statement_sql(select: str) -> str:
    return with_tables(f"with {_MAPPED.strip()}\n{select.strip()}", *_FACT_TABLES)


def report_measures(sign: str) -> str:
    return f"""
    cast({sign}sum(case when company_code = parent_company then tb + recl else 0 end) as double) as separate_fs,
    cast({sign}sum(tb + rpt + recl + te) as double) as consolidated_fs"""


def _report_sql(types: str, sign: str) -> str:
    return statement_sql(f"""
select {FS}, {report_measures(sign)} from m
where {ONE} and account_type in {types} group by {FS}
union all
select '', '', '', 'Total', {report_measures(sign)} from m
where {ONE} and account_type in {types}""")


def _report_all_sql(types: str, sign: str) -> str:
    return statement_sql(f"""
select parent_company, period_code, {FS}, {report_measures(sign)} from m
where account_type in {types} group by parent_company, period_code, {FS}
union all
select parent_company, period_code, '', '', '', 'Total', {report_measures(sign)} from m
where account_type in {types} group by parent_company, period_code""")


def _working_measures(sign: str) -> str:
    return f"""
    cast({sign}sum(tb + recl) as double) as total_separate,
    cast({sign}sum(rpt) as double) as eliminate,
    cast({sign}sum(te) as double) as take_equity,
    cast({sign}sum(tb + rpt + recl + te) as double) as total_conso"""


def working_sql(types: str, sign: str, total: bool) -> str:
    columns = ",\n    ".join(
        f"cast({sign}sum(case when company_code = '{c}' then tb + recl else 0 end) as double) as {c}"
        for c in GROUP_CODES[PARENT]
    )
    rows = f"""
select {WK}, {columns}, {_working_measures(sign)} from m
where {ONE} and account_type in {types} group by {WK}"""
    if total:
        rows += f"""
union all
select '', '', '', 'Total', {columns}, {_working_measures(sign)} from m
where {ONE} and account_type in {types}"""
    return statement_sql(rows)


def _working_long_sql(types: str, sign: str) -> str:
    return statement_sql(f"""
select parent_company, period_code, {WK}, company_code, {_working_measures(sign)} from m
where account_type in {types} group by parent_company, period_code, {WK}, company_code""")


_RPT = """
r as (
  select i.*, c.parent_company,
         coalesce(a.wk_group_row, 'n/a group') as wk_group_row,
         coalesce(g.wk_group_name, 'n/a group') as wk_group_name,
         coalesce(g.account_type, 'n/a group') as account_type,
         coalesce(g.account_subtype, 'n/a group') as account_subtype
  from fx_interco i
  join fx_company c on i.company_code = c.company_code
  left join fx_coa a on a.company_code = i.company_code and a.account_code = i.account_code
  left join fx_fsgroup g on g.company_code = c.parent_company and g.wk_group_row = a.wk_group_row)"""
_RPT_TABLES = ("fx_company", "fx_coa", "fx_fsgroup", "fx_interco")


def rpt_sql(total: bool) -> str:
    columns = ",\n    ".join(
        f"cast(sum(case when company_code = '{c}' then rpt_amount else 0 end) as double) as {c}"
        for c in GROUP_CODES[PARENT]
    )
    measure = "cast(sum(rpt_amount) as double) as total_rpt"
    rows = f"""
select {WK}, rpt_interco_code, {columns}, {measure} from r where {ONE}
group by {WK}, rpt_interco_code"""
    if total:
        rows += f"""
union all select '', '', '', 'Total', '', {columns}, {measure} from r where {ONE}"""
    return with_tables(f"with {_RPT.strip()}\n{rows.strip()}", *_RPT_TABLES)


# ---- queries ------------------------------------------------------------------------


def _report(statement, parent=PARENT, period=PERIOD):
    return lambda spark, sf: plain(st.report(books(spark, sf), parent, period, statement))


def _working(statement, total=True):
    return lambda spark, sf: plain(
        st.working(books(spark, sf), PARENT, PERIOD, statement, total)
    )


def _report_bs_display(spark, sf):
    shown = st.report(books(spark, sf), PARENT, PERIOD, "bs").withColumns(
        {name: money_text(name) for name in ("separate_fs", "consolidated_fs")}
    )
    return shaping.label(shaping.columns_last(shown, ["separate_fs", "consolidated_fs"]), LABELS["report"])


def _map_accounts(spark, sf):
    b = books(spark, sf)
    used = facts.sum_sources(facts.long_fact(b), "company_code", "account_code")
    mapped = mapping.map_to_groups(used, companies_under(b.company), b.coa, b.fs_group)
    return plain(
        mapped.select("parent_company", "company_code", "account_code", *mapping.GROUP_COLUMNS, *facts.SOURCES)
    )


def _unmapped_accounts(spark, sf):
    return _map_accounts(spark, sf).where(F.col("account_type") == UNMAPPED)


def _journal_facts(spark, sf):
    from ledgerfold.operators.quality import check_balanced

    b = books(spark, sf)
    balanced = b.journal_line.join(
        check_balanced(b.journal_line).select("journal_no"), "journal_no", "left_anti"
    )
    joined = mapping.journal_facts(b.journal_header, balanced)
    return plain(
        joined.select(
            "journal_no",
            "period_code",
            "company_code",
            "journal_type",
            "account_code",
            "debit",
            "credit",
            "journal_amount",
        )
    )


def _journal_rows(spark, sf):
    b = books(spark, sf)
    return b, facts.journal_fact(scope(b.journal_header, b.company, PARENT), b.journal_line)


def _outer_on_group(spark, sf):
    b, rows = _journal_rows(spark, sf)
    summed = facts.sum_sources(rows, "company_code", "account_code")
    mapped = mapping.map_to_groups(summed, companies_under(b.company, PARENT), b.coa, b.fs_group)
    groups = list(mapping.GROUP_COLUMNS)
    picked_up = mapped.groupBy(*groups).agg(F.sum("te").alias("take_equity"))
    codes = shaping.column_codes(companies_under(b.company, PARENT))
    reclassified = shaping.pivot_amount(mapped.where("recl <> 0"), "recl", groups, codes)
    return plain(mapping.outer_on_group(picked_up, reclassified))


def _pivot_tb(spark, sf):
    b = books(spark, sf)
    codes = shaping.column_codes(companies_under(b.company))
    keys = ["account_code", "period_code", "company_code"]
    return plain(shaping.pivot_amount(b.trial_balance, "tb_amount", keys, codes, "total_tb"))


def _pivot_interco(spark, sf):
    b = books(spark, sf)
    codes = shaping.column_codes(companies_under(b.company))
    keys = ["account_code", "period_code", "rpt_interco_code", "company_code"]
    return plain(shaping.pivot_amount(b.interco, "rpt_amount", keys, codes, "total_rpt"))


def _pivot_reclass(spark, sf):
    b, rows = _journal_rows(spark, sf)
    summed = facts.sum_sources(rows, "company_code", "account_code")
    mapped = mapping.map_to_groups(summed, companies_under(b.company, PARENT), b.coa, b.fs_group)
    codes = shaping.column_codes(companies_under(b.company, PARENT))
    keys = ["account_code", *mapping.GROUP_COLUMNS]
    return plain(shaping.pivot_amount(mapped, "recl", keys, codes))


def _split_journals(spark, sf):
    b = books(spark, sf)
    return plain(
        facts.split_journals(b.journal_header, b.journal_line, "company_code", "period_code")
    )


def _rollup_wk(spark, sf):
    fact = st.mapped_fact(books(spark, sf))
    return plain(facts.sum_sources(fact, *mapping.WORKING_KEYS))


def _stack_sources(spark, sf):
    b = books(spark, sf)
    tb = b.trial_balance.select("company_code", "period_code", "account_code", "tb_amount")
    interco = b.interco.select("company_code", "period_code", "account_code", "rpt_amount")
    journals = b.journal_header.select("journal_no", "company_code", "period_code").join(
        b.journal_line.select("journal_no", "account_code", journal_amount().alias("journal_amount")),
        "journal_no",
    )
    return plain(
        facts.stack(tb, journals.drop("journal_no"), interco)
        .groupBy("company_code", "period_code")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum("tb_amount").alias("tb_amount"),
            F.sum("rpt_amount").alias("rpt_amount"),
            F.sum("journal_amount").alias("journal_amount"),
        )
    )


QUERIES = {
    "report_bs": _report("bs"),
    "report_pl": _report("pl"),
    "report_bs_all": _report("bs", None, None),
    "report_pl_all": _report("pl", None, None),
    "report_bs_display": _report_bs_display,
    "working_bs": _working("bs", total=False),
    "working_bs_total": _working("bs"),
    "working_pl": _working("pl"),
    "working_bs_long": lambda spark, sf: plain(st.working_long(books(spark, sf), statement="bs")),
    "working_pl_long": lambda spark, sf: plain(st.working_long(books(spark, sf), statement="pl")),
    "rpt_result": lambda spark, sf: plain(
        st.rpt_result(books(spark, sf), PARENT, PERIOD, total=False)
    ),
    "rpt_result_total": lambda spark, sf: plain(st.rpt_result(books(spark, sf), PARENT, PERIOD)),
    "rpt_result_long": lambda spark, sf: plain(st.rpt_result_long(books(spark, sf))),
    "map_accounts": _map_accounts,
    "unmapped_accounts": _unmapped_accounts,
    "journal_facts": _journal_facts,
    "outer_on_group": _outer_on_group,
    "with_parent_name": lambda spark, sf: mapping.with_parent_name(books(spark, sf).company).select(
        "company_code", "company_name", "parent_company", "parent_company_name"
    ),
    "with_wk_group": lambda spark, sf: mapping.with_wk_group(
        books(spark, sf).coa, books(spark, sf).fs_group
    ).select("company_code", "account_code", "account_name", "wk_group_row"),
    "stack_sources": _stack_sources,
    "pivot_tb": _pivot_tb,
    "pivot_interco": _pivot_interco,
    "pivot_reclass": _pivot_reclass,
    "split_journals": _split_journals,
    "rollup_wk": _rollup_wk,
    "consolidate_by_company": lambda spark, sf: plain(
        st.consolidate_by_company(books(spark, sf))
    ),
}


def _by_code(amount: str, codes) -> str:
    return ",\n    ".join(
        f"cast(sum(case when company_code = '{c}' then {amount} else 0 end) as double) as {c}"
        for c in codes
    )


_MEASURES = ", ".join(f"cast(sum({n}) as double) as {n}" for n in ("tb", "rpt", "recl", "te"))
_GROUPS = "wk_group_row, wk_group_name, fs_group_row, fs_group_name, account_type, account_subtype"

SQL = {
    "report_bs": _report_sql(BS, ""),
    "report_pl": _report_sql(PL, "-"),
    "report_bs_all": _report_all_sql(BS, ""),
    "report_pl_all": _report_all_sql(PL, "-"),
    "report_bs_display": statement_sql(f"""
select account_type as "Account type", account_subtype as "Account subtype",
       fs_group_row as "FS group row", fs_group_name as "FS group name",
       format('{{:,.2f}}', separate_fs) as "Separate FS",
       format('{{:,.2f}}', consolidated_fs) as "Consolidated FS"
from (
  select {FS}, {report_measures('')} from m
  where {ONE} and account_type in {BS} group by {FS}
  union all
  select '', '', '', 'Total', {report_measures('')} from m
  where {ONE} and account_type in {BS})"""),
    "working_bs": working_sql(BS, "", total=False),
    "working_bs_total": working_sql(BS, "", total=True),
    "working_pl": working_sql(PL, "-", total=True),
    "working_bs_long": _working_long_sql(BS, ""),
    "working_pl_long": _working_long_sql(PL, "-"),
    "rpt_result": rpt_sql(total=False),
    "rpt_result_total": rpt_sql(total=True),
    "rpt_result_long": with_tables(f"""
with {_RPT.strip()}
select parent_company, period_code, {WK}, rpt_interco_code, company_code,
       cast(sum(rpt_amount) as double) as total_rpt
from r group by parent_company, period_code, {WK}, rpt_interco_code, company_code""", *_RPT_TABLES),
    "map_accounts": statement_sql(f"""
select parent_company, company_code, account_code, {_GROUPS}, {_MEASURES}
from m group by parent_company, company_code, account_code, {_GROUPS}"""),
    "unmapped_accounts": statement_sql(f"""
select parent_company, company_code, account_code, {_GROUPS}, {_MEASURES}
from m where account_type = 'n/a group' group by parent_company, company_code, account_code, {_GROUPS}"""),
    "journal_facts": with_tables("""
with balanced as (
  select journal_no from fx_journal group by journal_no
  having sum(coalesce(debit, 0)) = sum(coalesce(credit, 0)))
select h.journal_no, h.period_code, h.company_code, h.journal_type, l.account_code,
       cast(l.debit as double) as debit, cast(l.credit as double) as credit,
       cast(case when l.journal_no is not null then coalesce(l.debit, 0) - coalesce(l.credit, 0) end as double)
         as journal_amount
from fx_jheader h
left join (select * from fx_journal where journal_no in (select journal_no from balanced)) l
  on h.journal_no = l.journal_no""", "fx_jheader", "fx_journal"),
    "outer_on_group": statement_sql(f"""
select coalesce(t.wk_group_row, r.wk_group_row) as wk_group_row,
       coalesce(t.wk_group_name, r.wk_group_name) as wk_group_name,
       coalesce(t.fs_group_row, r.fs_group_row) as fs_group_row,
       coalesce(t.fs_group_name, r.fs_group_name) as fs_group_name,
       coalesce(t.account_type, r.account_type) as account_type,
       coalesce(t.account_subtype, r.account_subtype) as account_subtype,
       t.take_equity, {', '.join('r.' + c for c in GROUP_CODES[PARENT])}
from (select {_GROUPS}, cast(sum(te) as double) as take_equity from m
      where parent_company = 'C00' and (company_code, account_code) in (
        select (h.company_code, l.account_code) from fx_jheader h join fx_journal l on h.journal_no = l.journal_no)
      group by {_GROUPS}) t
full outer join (select {_GROUPS}, {_by_code('recl', GROUP_CODES[PARENT])}
      from (select company_code, account_code, {_GROUPS}, sum(recl) as recl from m
            where parent_company = 'C00' group by company_code, account_code, {_GROUPS} having sum(recl) <> 0)
      group by {_GROUPS}) r
  on t.wk_group_row = r.wk_group_row and t.wk_group_name = r.wk_group_name
 and t.fs_group_row = r.fs_group_row and t.fs_group_name = r.fs_group_name
 and t.account_type = r.account_type and t.account_subtype = r.account_subtype"""),
    "with_parent_name": with_tables("""
select c.company_code, c.company_name, c.parent_company, p.company_name as parent_company_name
from fx_company c left join fx_company p on c.parent_company = p.company_code""", "fx_company"),
    "with_wk_group": with_tables("""
select a.company_code, a.account_code, a.account_name, g.wk_group_row
from fx_coa a left join fx_fsgroup g on a.fs_group = g.fs_group_id""", "fx_coa", "fx_fsgroup"),
    "stack_sources": with_tables("""
select company_code, period_code, count(*) as row_count,
       cast(sum(tb_amount) as double) as tb_amount, cast(sum(rpt_amount) as double) as rpt_amount,
       cast(sum(journal_amount) as double) as journal_amount
from (
  select company_code, period_code, tb_amount, null as rpt_amount, null as journal_amount from fx_tb
  union all
  select company_code, period_code, null, rpt_amount, null from fx_interco
  union all
  select h.company_code, h.period_code, null, null, coalesce(debit, 0) - coalesce(credit, 0)
  from fx_jheader h join fx_journal l on h.journal_no = l.journal_no)
group by company_code, period_code""", "fx_tb", "fx_interco", "fx_jheader", "fx_journal"),
    "pivot_tb": with_tables(f"""
select account_code, period_code, company_code, {_by_code('tb_amount', COMPANY_CODES)},
       cast(sum(tb_amount) as double) as total_tb
from fx_tb group by account_code, period_code, company_code""", "fx_tb"),
    "pivot_interco": with_tables(f"""
select account_code, period_code, rpt_interco_code, company_code, {_by_code('rpt_amount', COMPANY_CODES)},
       cast(sum(rpt_amount) as double) as total_rpt
from fx_interco group by account_code, period_code, rpt_interco_code, company_code""", "fx_interco"),
    "pivot_reclass": statement_sql(f"""
select account_code, {_GROUPS}, {_by_code('recl', GROUP_CODES[PARENT])}
from m where parent_company = 'C00' and (company_code, account_code) in (
  select (h.company_code, l.account_code) from fx_jheader h join fx_journal l on h.journal_no = l.journal_no)
group by account_code, {_GROUPS}"""),
    "split_journals": with_tables("""
select h.company_code, h.period_code,
       cast(sum(case when h.journal_type = 'Reclassify' then coalesce(debit, 0) - coalesce(credit, 0) else 0 end)
            as double) as reclass_amount,
       cast(sum(case when h.journal_type = 'TakeEq' then coalesce(debit, 0) - coalesce(credit, 0) else 0 end)
            as double) as take_eq_amount
from fx_jheader h join fx_journal l on h.journal_no = l.journal_no
group by h.company_code, h.period_code""", "fx_jheader", "fx_journal"),
    "rollup_wk": statement_sql(f"select {WK}, {_MEASURES} from m group by {WK}"),
    "consolidate_by_company": statement_sql(f"""
select company_code, period_code, {_MEASURES},
       cast(sum(tb + recl) as double) as total_separate,
       cast(sum(tb + rpt + recl + te) as double) as total_conso
from m group by company_code, period_code"""),
}
