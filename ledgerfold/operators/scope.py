"""Row filters: tenant, period, statement and exact-match scopes."""

from collections.abc import Mapping
from datetime import date, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions import contains_ci
from ledgerfold.operators.joins import join_hot
from ledgerfold.schemas import STATEMENTS


def companies_under(company: DataFrame, parent: str | None = None) -> DataFrame:
    """Company and parent codes in scope: one group of companies, or every group."""
    in_scope = F.col("parent_company").isNotNull() if parent is None else (
        F.col("parent_company") == parent
    )
    return company.where(in_scope).select("company_code", "parent_company")


def scope(df: DataFrame, company: DataFrame, parent: str | None = None) -> DataFrame:
    """Rows whose company belongs to the parent."""
    companies = companies_under(company, parent).select("company_code")
    return join_hot(df, companies, ["company_code"], "left_semi")


def in_period(df: DataFrame, period: str | None) -> DataFrame:
    """Rows of one period; on tables stored by period this prunes partitions."""
    return df if period is None else df.where(F.col("period_code") == period)


def statement_filter(df: DataFrame, statement: str) -> DataFrame:
    """Balance-sheet ('bs') or profit-and-loss ('pl') account types."""
    return df.where(F.col("account_type").isin(*STATEMENTS[statement]))


def any_equals(df: DataFrame, wanted: Mapping[str, str | None]) -> DataFrame:
    """Rows matching any of the values; ignored unless some value is longer than one character."""
    values = {name: value or "" for name, value in wanted.items()}
    if all(len(value) <= 1 for value in values.values()):
        return df
    return df.where(reduce(or_, (F.col(name) == value for name, value in values.items())))


def all_of(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Every given condition must hold; absent ones (None) are ignored."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(and_, given)) if given else df


def maybe_contains(name: str, text: str | None) -> Column | None:
    return contains_ci(name, text) if text else None


def maybe_equals(name: str, value) -> Column | None:
    return None if value in (None, "") else F.col(name) == value


def between_days(name: str, first: date, after: date) -> Column:
    """Half-open range on a raw timestamp column, which reaches the Parquet reader.

    The bounds are wall-clock texts, so neither the session's nor this process's time
    zone shifts them.
    """

    def midnight(day: date) -> Column:
        return F.lit(f"{day.isoformat()} 00:00:00").cast("timestamp_ntz")

    return (F.col(name) >= midnight(first)) & (F.col(name) < midnight(after))


def on_day(df: DataFrame, name: str, day: str | None) -> DataFrame:
    """Rows of one calendar day, given as yyyy-MM-dd; a blank or one-character day is ignored."""
    if day is None or len(day) <= 1:
        return df
    first = date.fromisoformat(day)
    return df.where(between_days(name, first, first + timedelta(days=1)))


def open_periods(period: DataFrame, company: str | None = None) -> DataFrame:
    return all_of(
        period, F.col("period_status") == "Open", maybe_equals("company_code", company)
    )


def journals_of(header: DataFrame, journal_type: str, parent: str | None = None) -> DataFrame:
    return all_of(
        header,
        F.col("journal_type") == journal_type,
        maybe_equals("parent_company_code", parent),
    )
