"""Administrative reports over subscriptions, companies, users and the audit log."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions import contains_ci, date_text, money_text, time_text, timestamp_text
from ledgerfold.operators.joins import join_hot
from ledgerfold.operators.scope import (
    all_of,
    any_equals,
    between_days,
    companies_under,
    maybe_equals,
    on_day,
)


def subscription_report(
    books, company_code: str = "", company_name: str = "", plan_code: str = ""
) -> DataFrame:
    joined = (
        books.subscription.join(
            books.company.select("company_code", "company_name"), "company_code", "left"
        )
        .join(books.plan.select("plan_code", "plan_description", "plan_price"), "plan_code", "left")
        .select(
            "company_code",
            "company_name",
            "plan_code",
            "plan_description",
            "plan_price",
            "start_date",
            "end_date",
        )
    )
    return any_equals(
        joined,
        {"company_code": company_code, "company_name": company_name, "plan_code": plan_code},
    )


def _parent_counts(company: DataFrame) -> DataFrame:
    return (
        company.where(F.col("parent_company").isNotNull())
        .groupBy("parent_company")
        .agg(F.count(F.lit(1)).alias("company_count"))
    )


def company_count(company: DataFrame) -> DataFrame:
    """Number of companies under the same parent, on every row; null for a null parent.

    Counted and joined back: counting combines before the shuffle and the join can split
    a parent that has most of the companies, which a window could not.
    """
    return join_hot(company, _parent_counts(company), ["parent_company"], "left")


def company_member_report(
    books, company_code: str = "", company_name: str = "", parent_company: str = ""
) -> DataFrame:
    """Companies with their parent's name and the size of their group, counted before filtering.

    Name and size are put together per parent, one row each, before the companies join.
    """
    names = books.company.select(
        F.col("company_code").alias("parent_company"),
        F.col("company_name").alias("parent_company_name"),
    )
    parents = _parent_counts(books.company).join(names, "parent_company", "left")
    members = join_hot(books.company, parents, ["parent_company"], "left").select(
        "parent_company",
        "parent_company_name",
        "company_code",
        "company_name",
        "company_type",
        "country",
        "currency",
        "company_est_date",
        "company_start_date",
        "company_end_date",
        "company_count",
    )
    return any_equals(
        members,
        {
            "company_code": company_code,
            "company_name": company_name,
            "parent_company": parent_company,
        },
    )


def plan_price_report(books) -> DataFrame:
    return books.plan.withColumn("price", money_text("plan_price"))


def user_report(
    books,
    username: str = "",
    first_name: str = "",
    last_name: str = "",
    company_code: str = "",
    parent: str | None = None,
) -> DataFrame:
    """One row per user and group; users without a group or a company stay."""
    companies = books.company.select("company_id", "company_code", "company_name")
    users = books.user
    if parent is not None:
        users = users.join(
            books.company.where(F.col("parent_company") == parent).select("company_id"),
            "company_id",
            "left_semi",
        )
    joined = (
        users.join(books.user_group, "user_id", "left")
        .join(books.group, "group_id", "left")
        .join(companies, "company_id", "left")
        .select(
            "username",
            "first_name",
            "last_name",
            "company_code",
            "company_name",
            "group_name",
            "is_superuser",
            "is_staff",
            "is_active",
            timestamp_text("date_joined").alias("date_joined"),
            timestamp_text("last_login").alias("last_login"),
        )
    )
    return any_equals(
        joined,
        {
            "username": username,
            "first_name": first_name,
            "last_name": last_name,
            "company_code": company_code,
        },
    )


def groups_per_user(books) -> DataFrame:
    """Group names of each user joined by a space; a list never outgrows the number of groups."""
    return (
        books.user_group.join(books.group, "group_id")
        .groupBy("user_id")
        .agg(F.concat_ws(" ", F.sort_array(F.collect_set("group_name"))).alias("groups"))
    )


def _log_with_names(books) -> DataFrame:
    users = books.user.select("user_id", "username", "first_name", "last_name")
    return books.admin_log.join(books.content_type, "content_type_id", "left").join(
        users, "user_id", "left"
    )


def admin_log_report(books, day: str = "", username: str = "") -> DataFrame:
    """The log with content types and users, of one day if given (yyyy-MM-dd).

    The day is tested on the stored timestamp, before any formatting, so that it is
    applied while the log is read.
    """
    joined = all_of(
        on_day(_log_with_names(books), "action_time", day), maybe_equals("username", username)
    )
    return joined.select(
        "id",
        "content_type_id",
        "app_label",
        "model",
        "object_id",
        "object_repr",
        "action_flag",
        "change_message",
        "user_id",
        "username",
        "first_name",
        "last_name",
        date_text("action_time").alias("action_date"),
        time_text("action_time").alias("action_time"),
    )


def search_log(
    books,
    user_id: int | None = None,
    content_type_id: int | None = None,
    text: str = "",
    year: int | None = None,
    month: int | None = None,
    day: int | None = None,
) -> DataFrame:
    """Browse the log by user, content type, text, and year, month and day."""
    when = None
    if year is not None:
        first = date(year, month or 1, day or 1)
        if month is None:
            after = date(year + 1, 1, 1)
        elif day is None:
            after = date(year + month // 12, month % 12 + 1, 1)
        else:
            after = date.fromordinal(first.toordinal() + 1)
        when = between_days("action_time", first, after)
    found = None
    if text:
        found = contains_ci("object_repr", text) | contains_ci("change_message", text)
    return all_of(
        books.admin_log,
        maybe_equals("user_id", user_id),
        maybe_equals("content_type_id", content_type_id),
        found,
        when,
    ).select(
        "id",
        "content_type_id",
        "object_repr",
        "change_message",
        "user_id",
        timestamp_text("action_time").alias("action_time"),
    )


def search_users(books, text: str) -> DataFrame:
    """Users whose email, first name or company contains the text, by email."""
    companies = books.company.select("company_id", "company_code")
    users = books.user.join(companies, "company_id", "left")
    found = (
        contains_ci("email", text)
        | contains_ci("first_name", text)
        | F.coalesce(contains_ci("company_code", text), F.lit(False))
    )
    return (
        users.where(found)
        .select("username", "email", "first_name", "last_name", "company_code", "is_active")
        .orderBy("email", "username")
    )


def member_summary(books, parent: str) -> DataFrame:
    """Users of the companies under a parent."""
    companies = companies_under(books.company, parent).select("company_code")
    ids = books.company.join(companies, "company_code", "left_semi").select("company_id")
    return books.user.join(ids, "company_id", "left_semi").select(
        "username", "email", "first_name", "last_name", "company_id"
    )


