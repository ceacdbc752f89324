"""The derived tables as SQL, written apart from the DataFrame derivation."""

TABLES = {
    "fx_company": ("""
select cast(n_nationkey as bigint) as company_id,
       printf('C%02d', n_nationkey) as company_code,
       n_name as company_name,
       case when n_nationkey = n_regionkey then 'Parent'
            when n_nationkey % 3 = 0 then 'Associate' else 'Subsidiary' end as company_type,
       printf('C%02d', n_regionkey) as parent_company,
       cast('2000-01-01' as date) + n_nationkey as company_est_date,
       'Thailand' as country, 'THB' as currency, cast(100.0 as double) as consolidation_rate,
       cast('2001-01-01' as date) + n_nationkey as company_start_date,
       case when n_nationkey % 4 = 0 then cast('2021-12-31' as date) end as company_end_date
from nation""", ()),
    "fx_period": ("""
select c.company_code, q.period_code, 'Period ' || q.period_code as period_description,
       case when q.period_code = 'Q1_1997' then 'Open'
            when q.y > 1997 then 'Never Open' else 'Closed' end as period_status,
       q.period_date_from, q.period_date_to
from fx_company c cross join (
  select 'Q' || cast(quarter(o_orderdate) as string) || '_' || cast(year(o_orderdate) as string) as period_code,
         year(o_orderdate) as y,
         min(cast(o_orderdate as date)) as period_date_from,
         max(cast(o_orderdate as date)) as period_date_to
  from orders group by 1, 2) q""", ("fx_company",)),
    "fx_coa": ("""
select company_code, cast(1000 + 10 * s as string) as account_code,
       'Account ' || cast(s as string) as account_name,
       cast(substring(parent_company, 2) as bigint) * 100000 + cast(floor((s - 1) / 2) as bigint) as fs_group,
       printf('W%02d', cast(floor((s - 1) / 2) as int)) as wk_group_row
from fx_company cross join (select distinct p_size as s from part where p_size <> 48) p""",
               ("fx_company",)),
    "fx_fsgroup": ("""
select cast(substring(parent_company, 2) as bigint) * 100000 + w as fs_group_id,
       parent_company as company_code,
       printf('F%02d', f) as fs_group_row, 'FS ' || cast(f as string) as fs_group_name,
       printf('W%02d', w) as wk_group_row, 'WK ' || cast(w as string) as wk_group_name,
       case when f < 4 then 'สินทรัพย์' when f < 6 then 'หนี้สิน' when f < 8 then 'ส่วนของผู้ถือหุ้น'
            when f < 10 then 'รายได้' else 'ค่าใช้จ่าย' end as account_type,
       case when f < 2 then 'สินทรัพย์หมุนเวียน' when f < 4 then 'สินทรัพย์ไม่หมุนเวียน'
            when f < 5 then 'หนี้สินหมุนเวียน' when f < 6 then 'หนี้สินไม่หมุนเวียน'
            when f < 8 then 'ส่วนของผู้ถือหุ้น' when f < 10 then 'รายได้' else 'ค่าใช้จ่าย' end as account_subtype
from (select distinct parent_company from fx_company) c
cross join (select distinct cast(floor((p_size - 1) / 2) as int) as w,
                   cast(floor(floor((p_size - 1) / 2) / 2) as int) as f
            from part where p_size <= 48) g""", ("fx_company",)),
    "fx_line": ("""
select printf('C%02d', c_nationkey) as company_code,
       printf('C%02d', s_nationkey) as partner_code,
       'Q' || cast(quarter(o_orderdate) as string) || '_' || cast(year(o_orderdate) as string) as period_code,
       p_size as s, cast(l_extendedprice as decimal(15,2)) as amt, l_returnflag
from lineitem
join orders on l_orderkey = o_orderkey
join customer on o_custkey = c_custkey
join supplier on l_suppkey = s_suppkey
join part on l_partkey = p_partkey""", ()),
    "fx_tb": ("""
select company_code, period_code, cast(1000 + 10 * s as string) as account_code,
       cast(case when l_returnflag = 'R' then -amt else amt end as decimal(15,2)) as tb_amount,
       'TB_' || company_code || '_' || period_code || '.xlsx' as tb_file_name
from fx_line
union all
select company_code, period_code, cast(1000 + 10 * (51 - s) as string),
       cast(case when l_returnflag = 'R' then amt else -amt end as decimal(15,2)),
       'TB_' || company_code || '_' || period_code || '.xlsx'
from fx_line""", ("fx_line",)),
    "fx_interco": ("""
select l.company_code, l.period_code, l.partner_code as rpt_interco_code,
       cast(1000 + 10 * l.s as string) as account_code, cast(-l.amt as decimal(15,2)) as rpt_amount,
       'RPT_' || l.company_code || '_' || l.period_code || '.xlsx' as rpt_file_name
from fx_line l
join fx_company a on l.company_code = a.company_code
join fx_company b on l.partner_code = b.company_code
where a.parent_company = b.parent_company and a.company_code <> b.company_code""",
                   ("fx_company", "fx_line")),
    "fx_jheader": ("""
select c.parent_company || '_JV_' || printf('%08d', o_orderkey) as journal_no,
       'Q' || cast(quarter(o_orderdate) as string) || '_' || cast(year(o_orderdate) as string) as period_code,
       c.parent_company as parent_company_code, c.company_code,
       case when o_orderpriority = '1-URGENT' then 'Reclassify' else 'TakeEq' end as journal_type,
       'Order ' || cast(o_orderkey as string) as journal_description,
       o_orderkey as k, cast(o_totalprice as decimal(15,2)) as amt
from orders
join customer on o_custkey = c_custkey
join fx_company c on c.company_code = printf('C%02d', c_nationkey)""", ("fx_company",)),
    "fx_journal": ("""
select journal_no, k, cast(1000 + 10 * (k % 50 + 1) as string) as account_code,
       'Account ' || cast(k % 50 + 1 as string) as account_name,
       amt as debit, cast(null as decimal(15,2)) as credit
from fx_jheader
union all
select journal_no, k, cast(1000 + 10 * ((k + 25) % 50 + 1) as string),
       'Account ' || cast((k + 25) % 50 + 1 as string),
       cast(null as decimal(15,2)), cast(case when k % 97 = 0 then amt + 1 else amt end as decimal(15,2))
from fx_jheader""", ("fx_jheader",)),
    "fx_plan": ("""
select 'P' || cast(r_regionkey as string) as plan_code, r_name as plan_description,
       cast(100 * (r_regionkey + 1) as double) as plan_price
from region""", ()),
    "fx_subscription": ("""
select printf('C%02d', n_nationkey) as company_code,
       'P' || cast(n_nationkey % 6 as string) as plan_code,
       cast('2021-01-01' as date) as start_date,
       case when n_nationkey % 4 = 0 then cast('2021-12-31' as date) end as end_date
from nation""", ()),
    "fx_user": ("""
select c_custkey as user_id, c_name as username,
       lower(replace(c_name, '#', '.')) || '@example.com' as email,
       'First' || cast(c_custkey % 7 as string) as first_name,
       c_mktsegment as last_name, cast(c_nationkey as bigint) as company_id,
       c_custkey % 50 = 0 as is_superuser, c_custkey % 10 = 0 as is_staff, c_acctbal >= 0 as is_active,
       timestamp '2021-01-01 00:00:00' + to_hours(cast(c_custkey % 100000 as int)) as date_joined,
       case when c_custkey % 3 <> 0
            then timestamp '2021-01-02 00:00:00' + to_hours(cast(c_custkey % 100000 as int)) end as last_login
from customer""", ()),
    "fx_group": ("""
select 0 as group_id, 'Manager' as group_name
union all select 1, 'Accountant'
union all select 2, 'Viewer'""", ()),
    "fx_user_group": ("""
select c_custkey as user_id, cast(c_custkey % 4 as int) as group_id from customer where c_custkey % 4 < 3
union all
select c_custkey, 2 from customer where c_custkey % 20 = 0""", ()),
    "fx_content_type": ("""
select 0 as content_type_id, 'fin' as app_label, 'view' as model
union all select 1, 'fin', 'click'
union all select 2, 'fin', 'purchase'
union all select 3, 'auth', 'signup'""", ()),
    "fx_admin_log": ("""
select event_id as id, ts as action_time, user_id,
       case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2
                       when 'signup' then 3 else 9 end as content_type_id,
       cast(user_id as string) as object_id, event_type as object_repr,
       cast(event_id % 3 + 1 as int) as action_flag, props as change_message
from events""", ()),
    "fx_upload": ("""
select printf('C%02d', user_id % 25) as company_code, 'Q1_2024' as period_code,
       event_type || '[' || cast(user_id % 3 as string) || '].xlsx' as raw_file_name,
       ts as tb_date_create, cast(value as decimal(15,2)) as tb_amount
from events""", ()),
}


def with_tables(query: str, *names: str) -> str:
    """Put the named derived tables, and those they need, in front of a query."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in TABLES[name][1]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{name} as ({TABLES[name][0].strip()})" for name in ordered)
    body = query.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
