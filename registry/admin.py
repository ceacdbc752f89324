"""Administrative reports and listings."""

from ledgerfold.functions import title_case
from ledgerfold.operators.shaping import label
from ledgerfold.plans import admin, listings
from ledgerfold.schemas import LABELS
from registry.inputs import PARENT, books
from registry.tables_sql import with_tables

DAY = "2024-01-15"

QUERIES = {
    "subscription_report": lambda spark, sf: admin.subscription_report(books(spark, sf)),
    "subscription_report_filtered": lambda spark, sf: admin.subscription_report(
        books(spark, sf), company_code="C03", company_name="N", plan_code="P5"
    ),
    "company_member_report": lambda spark, sf: admin.company_member_report(books(spark, sf)),
    "company_member_report_filtered": lambda spark, sf: admin.company_member_report(
        books(spark, sf), company_name="NATION_7", parent_company="C01"
    ),
    "company_member_report_labels": lambda spark, sf: label(
        admin.company_member_report(books(spark, sf)), LABELS["company_member"]
    ),
    "company_count": lambda spark, sf: admin.company_count(books(spark, sf).company).select(
        "company_code", "parent_company", "company_count"
    ),
    "plan_price_report": lambda spark, sf: admin.plan_price_report(books(spark, sf)),
    "user_report": lambda spark, sf: admin.user_report(books(spark, sf)),
    "user_report_filtered": lambda spark, sf: admin.user_report(
        books(spark, sf), first_name="First3", company_code="C11"
    ),
    "groups_per_user": lambda spark, sf: admin.groups_per_user(books(spark, sf)),
    "admin_log_report": lambda spark, sf: admin.admin_log_report(books(spark, sf)),
    "admin_log_report_day": lambda spark, sf: admin.admin_log_report(books(spark, sf), DAY),
    "search_log": lambda spark, sf: admin.search_log(
        books(spark, sf), content_type_id=1, text='"k": 8', year=2024, month=1
    ),
    "search_users": lambda spark, sf: admin.search_users(books(spark, sf), "first3"),
    "greeting_names": lambda spark, sf: books(spark, sf).user.select(
        "username",
        title_case("first_name").alias("first_name"),
        title_case("last_name").alias("last_name"),
    ),
    "member_summary": lambda spark, sf: admin.member_summary(books(spark, sf), PARENT),
    "coa_summary": lambda spark, sf: listings.coa_summary(books(spark, sf), PARENT),
    "search_coa": lambda spark, sf: listings.search_coa(
        books(spark, sf).coa, account_name="account 1", wk_group_row="w0"
    ),
    "fs_group_summary": lambda spark, sf: listings.fs_group_summary(books(spark, sf), PARENT),
    "search_fs_group": lambda spark, sf: listings.search_fs_group(
        books(spark, sf).fs_group, wk_group_name="wk 1", account_type="สิน"
    ),
    "search_periods": lambda spark, sf: listings.search_periods(books(spark, sf), "q", PARENT),
    "periods_summary": lambda spark, sf: listings.periods_summary(books(spark, sf), PARENT),
    "company_summary": lambda spark, sf: listings.company_summary(books(spark, sf), PARENT),
    "current_period": lambda spark, sf: listings.current_period(books(spark, sf), PARENT),
    "open_periods": lambda spark, sf: listings.current_period(books(spark, sf)),
}

_SUBSCRIPTION = """
select s.company_code, c.company_name, s.plan_code, p.plan_description, p.plan_price, s.start_date, s.end_date
from fx_subscription s left join fx_company c on s.company_code = c.company_code
left join fx_plan p on s.plan_code = p.plan_code"""
_MEMBER = """
select c.parent_company, p.company_name as parent_company_name, c.company_code, c.company_name, c.company_type,
       c.country, c.currency, c.company_est_date, c.company_start_date, c.company_end_date,
       case when c.parent_company is not null
            then count(c.parent_company) over (partition by c.parent_company) end as company_count
from fx_company c left join fx_company p on c.parent_company = p.company_code"""
_USERS = """
select u.username, u.first_name, u.last_name, c.company_code, c.company_name, g.group_name,
       u.is_superuser, u.is_staff, u.is_active,
       strftime(u.date_joined, '%Y-%m-%d %H:%M:%S') as date_joined,
       strftime(u.last_login, '%Y-%m-%d %H:%M:%S') as last_login
from fx_user u left join fx_user_group ug on u.user_id = ug.user_id
left join fx_group g on ug.group_id = g.group_id
left join fx_company c on u.company_id = c.company_id"""
_LOG = """
select l.id, l.content_type_id, t.app_label, t.model, l.object_id, l.object_repr, l.action_flag, l.change_message,
       l.user_id, u.username, u.first_name, u.last_name,
       strftime(l.action_time, '%Y-%m-%d') as action_date, strftime(l.action_time, '%H:%M:%S') as action_time
from fx_admin_log l left join fx_content_type t on l.content_type_id = t.content_type_id
left join fx_user u on l.user_id = u.user_id"""
_LOG_TABLES = ("fx_admin_log", "fx_content_type", "fx_user")
_USER_TABLES = ("fx_user", "fx_user_group", "fx_group", "fx_company")

SQL = {
    "subscription_report": with_tables(_SUBSCRIPTION, "fx_subscription", "fx_company", "fx_plan"),
    "subscription_report_filtered": with_tables(
        _SUBSCRIPTION + " where s.company_code = 'C03' or c.company_name = 'N' or s.plan_code = 'P5'",
        "fx_subscription", "fx_company", "fx_plan"),
    "company_member_report": with_tables(_MEMBER, "fx_company"),
    "company_member_report_filtered": with_tables(
        f"select * from ({_MEMBER}) where company_name = 'NATION_7' or parent_company = 'C01'", "fx_company"),
    "company_member_report_labels": with_tables(f"""
select parent_company as "Parent company code", parent_company_name as "Parent company name",
       company_code as "Company code", company_name as "Company name", company_type as "company type",
       country as "Country", currency as "Currency", company_est_date as "Established date",
       company_start_date as "Start date", company_end_date as "End date", company_count as "Company count"
from ({_MEMBER})""", "fx_company"),
    "company_count": with_tables("""
select company_code, parent_company,
       case when parent_company is not null
            then count(parent_company) over (partition by parent_company) end as company_count
from fx_company""", "fx_company"),
    "plan_price_report": with_tables("""
select plan_code, plan_description, plan_price, format('{:,.2f}', plan_price) as price from fx_plan""", "fx_plan"),
    "user_report": with_tables(_USERS, *_USER_TABLES),
    "user_report_filtered": with_tables(
        f"select * from ({_USERS}) where username = '' or first_name = 'First3' or last_name = ''"
        " or company_code = 'C11'", *_USER_TABLES),
    "groups_per_user": with_tables("""
select user_id, string_agg(distinct group_name, ' ' order by group_name) as groups
from fx_user_group join fx_group using (group_id) group by user_id""", "fx_user_group", "fx_group"),
    "admin_log_report": with_tables(_LOG, *_LOG_TABLES),
    "admin_log_report_day": with_tables(
        f"select * from ({_LOG}) where action_date = '2024-01-15'", *_LOG_TABLES),
    "search_log": with_tables("""
select id, content_type_id, object_repr, change_message, user_id,
       strftime(action_time, '%Y-%m-%d %H:%M:%S') as action_time
from fx_admin_log
where content_type_id = 1 and year(action_time) = 2024 and month(action_time) = 1
  and (contains(lower(object_repr), '"k": 8') or contains(lower(change_message), '"k": 8'))""", "fx_admin_log"),
    "search_users": with_tables("""
select u.username, u.email, u.first_name, u.last_name, c.company_code, u.is_active
from fx_user u left join fx_company c on u.company_id = c.company_id
where contains(lower(u.email), 'first3') or contains(lower(u.first_name), 'first3')
   or contains(lower(c.company_code), 'first3')""", "fx_user", "fx_company"),
    "greeting_names": with_tables("""
select username, upper(first_name[1]) || lower(first_name[2:]) as first_name,
       upper(last_name[1]) || lower(last_name[2:]) as last_name
from fx_user""", "fx_user"),
    "member_summary": with_tables("""
select username, email, first_name, last_name, company_id from fx_user
where company_id in (select company_id from fx_company where parent_company = 'C00')""", "fx_user", "fx_company"),
    "coa_summary": with_tables("""
select a.company_code, a.account_code, a.account_name, g.wk_group_row, g.wk_group_name, g.fs_group_row,
       g.fs_group_name, g.account_type
from fx_coa a join fx_fsgroup g on a.fs_group = g.fs_group_id
where a.company_code in (select company_code from fx_company where parent_company = 'C00')""",
                               "fx_coa", "fx_fsgroup", "fx_company"),
    "search_coa": with_tables("""
select * from fx_coa where contains(lower(account_name), 'account 1') and contains(lower(wk_group_row), 'w0')""",
                              "fx_coa"),
    "fs_group_summary": with_tables("select * from fx_fsgroup where company_code = 'C00'", "fx_fsgroup"),
    "search_fs_group": with_tables("""
select * from fx_fsgroup where contains(lower(wk_group_name), 'wk 1') and contains(account_type, 'สิน')""",
                                   "fx_fsgroup"),
    "search_periods": with_tables("""
select company_code, period_code, period_description, period_date_from, period_date_to, period_status
from fx_period where contains(lower(period_code), 'q') and company_code = 'C00' order by period_code limit 10""",
                                  "fx_period"),
    "periods_summary": with_tables("select * from fx_period where company_code = 'C00'", "fx_period"),
    "company_summary": with_tables("""
select company_code, company_name, company_type, country, currency,
       printf('%.2f %%', consolidation_rate) as rate_label,
       strftime(company_est_date, '%-d %b %Y') as est_date_label,
       strftime(company_start_date, '%-d %b %Y') as start_date_label,
       strftime(company_end_date, '%-d %b %Y') as end_date_label
from fx_company where parent_company = 'C00'""", "fx_company"),
    "current_period": with_tables(
        "select * from fx_period where company_code = 'C00' and period_status = 'Open'", "fx_period"),
    "open_periods": with_tables("select * from fx_period where period_status = 'Open'", "fx_period"),
}
