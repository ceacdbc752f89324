"""Column helpers, all built from JVM-side Spark functions."""

from ledgerfold.functions.amounts import (
    as_money,
    journal_amount,
    money_text,
    percent_text,
    row_sum,
    zero_if_null,
)
from ledgerfold.functions.text import (
    clean_file_name,
    contains_ci,
    equals_ci,
    or_unmapped,
    title_case,
)
from ledgerfold.functions.times import (
    date_label,
    date_text,
    minute_of,
    minute_label,
    time_text,
    timestamp_text,
)

__all__ = [
    "as_money",
    "clean_file_name",
    "contains_ci",
    "date_label",
    "date_text",
    "equals_ci",
    "journal_amount",
    "minute_label",
    "minute_of",
    "money_text",
    "or_unmapped",
    "percent_text",
    "row_sum",
    "time_text",
    "timestamp_text",
    "title_case",
    "zero_if_null",
]
