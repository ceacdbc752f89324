"""Lists of uploads, journals, accounts, groups, companies and periods."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions import (
    clean_file_name,
    date_label,
    minute_label,
    minute_of,
    percent_text,
    zero_if_null,
)
from ledgerfold.operators.joins import join_hot
from ledgerfold.operators.quality import journal_totals
from ledgerfold.operators.scope import (
    all_of,
    journals_of,
    maybe_contains,
    maybe_equals,
    open_periods,
    scope,
)
from ledgerfold.operators.shaping import first_n


def upload_summary(
    df: DataFrame,
    file_column: str = "tb_file_name",
    amount: str = "tb_amount",
    created: str = "tb_date_create",
) -> DataFrame:
    """Loaded amount per company, period, minute and file, latest first."""
    return (
        df.groupBy(
            "company_code", "period_code", minute_of(created).alias("date_create"), file_column
        )
        .agg(F.sum(amount).alias("amount_sum"))
        .withColumn("date_label", minute_label("date_create"))
        .orderBy(F.desc("date_create"), "company_code", "period_code", file_column)
    )


def file_rows(df: DataFrame, file_column: str) -> DataFrame:
    """Stored rows of each file, by its cleaned name."""
    return df.groupBy(clean_file_name(file_column).alias(file_column)).agg(
        F.count(F.lit(1)).alias("row_count")
    )


def journal_summary(
    books,
    journal_type: str,
    parent: str | None = None,
    journal_no: str = "",
    period_code: str = "",
    company_code: str = "",
) -> DataFrame:
    """Journals of a type, searched by number, period and company, in number order."""
    return all_of(
        journals_of(books.journal_header, journal_type, parent),
        maybe_contains("journal_no", journal_no),
        maybe_contains("period_code", period_code),
        maybe_contains("company_code", company_code),
    ).orderBy("journal_no")


def journal_detail(books, journal_no: str | None = None) -> DataFrame:
    """Header, lines and totals of one journal, or of all.

    Totals are summed and joined back rather than taken over a window, and headers and
    totals meet before the lines do: the lines then pass a single join, in which a journal
    with very many of them can be split.
    """
    headers = all_of(books.journal_header, maybe_equals("journal_no", journal_no)).select(
        "journal_no", "period_code", "company_code", "journal_type"
    )
    lines = all_of(books.journal_line, maybe_equals("journal_no", journal_no)).select(
        "journal_no",
        "account_code",
        zero_if_null("debit").alias("debit"),
        zero_if_null("credit").alias("credit"),
    )
    totalled = headers.join(journal_totals(lines), "journal_no")
    return join_hot(lines, totalled, ["journal_no"], "inner")


def coa_summary(
    books,
    parent: str | None = None,
    company_code: str = "",
    account_code: str = "",
    account_name: str = "",
    wk_group_row: str = "",
) -> DataFrame:
    """Accounts of a parent's companies with the group each points at, searched and sorted."""
    groups = books.fs_group.select(
        F.col("fs_group_id").alias("fs_group"),
        "wk_group_row",
        "wk_group_name",
        "fs_group_row",
        "fs_group_name",
        "account_type",
    )
    return (
        search_coa(
            scope(books.coa, books.company, parent),
            company_code,
            account_code,
            account_name,
            wk_group_row,
        )
        .drop("wk_group_row")
        .join(groups, "fs_group")
        .drop("fs_group")
        .orderBy("company_code", "account_code")
    )


def search_coa(
    coa: DataFrame,
    company_code: str = "",
    account_code: str = "",
    account_name: str = "",
    wk_group_row: str = "",
) -> DataFrame:
    return all_of(
        coa,
        maybe_equals("company_code", company_code),
        maybe_contains("account_code", account_code),
        maybe_contains("account_name", account_name),
        maybe_contains("wk_group_row", wk_group_row),
    )


FS_GROUP_SEARCH = (
    "wk_group_row",
    "wk_group_name",
    "fs_group_row",
    "fs_group_name",
    "account_type",
    "account_subtype",
)


def search_fs_group(fs_group: DataFrame, **texts: str) -> DataFrame:
    unknown = set(texts) - set(FS_GROUP_SEARCH)
    if unknown:
        raise ValueError(f"no such search column: {sorted(unknown)}")
    return all_of(fs_group, *(maybe_contains(name, text) for name, text in texts.items()))


def fs_group_summary(books, parent: str | None = None, **texts: str) -> DataFrame:
    own = all_of(books.fs_group, maybe_equals("company_code", parent))
    return search_fs_group(own, **texts).orderBy("company_code", "wk_group_row")


def company_summary(books, parent: str | None = None) -> DataFrame:
    """Companies of a parent with their display labels."""
    return (
        all_of(books.company, maybe_equals("parent_company", parent))
        .select(
            "company_code",
            "company_name",
            "company_type",
            "country",
            "currency",
            percent_text("consolidation_rate").alias("rate_label"),
            date_label("company_est_date").alias("est_date_label"),
            date_label("company_start_date").alias("start_date_label"),
            date_label("company_end_date").alias("end_date_label"),
        )
        .orderBy("company_code")
    )


def periods_summary(books, company: str | None = None) -> DataFrame:
    """Periods of a company, the latest first."""
    return all_of(books.period, maybe_equals("company_code", company)).orderBy(
        "company_code", F.desc("period_date_to")
    )


def search_periods(books, keyword: str, company: str) -> DataFrame:
    """First ten periods of a company whose code contains the keyword."""
    found = all_of(
        books.period, maybe_contains("period_code", keyword), maybe_equals("company_code", company)
    )
    return first_n(found, ["period_code", "company_code"])


def current_period(books, company: str | None = None) -> DataFrame:
    return open_periods(books.period, company)
