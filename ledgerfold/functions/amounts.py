"""Money: exact decimals until a report is displayed."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold.schemas import MONEY


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def as_money(col) -> Column:
    """Text or number to money; text that is no number becomes null."""
    return F.col(col).try_cast(MONEY) if isinstance(col, str) else col.try_cast(MONEY)


def zero_if_null(col) -> Column:
    return F.coalesce(col, zero())


def journal_amount(debit="debit", credit="credit") -> Column:
    """Signed amount of a journal line: debit less credit, blanks counting as nothing."""
    return (zero_if_null(debit) - zero_if_null(credit)).cast(MONEY)


def row_sum(*cols) -> Column:
    """Sum across columns of one row, nulls skipped; flat, however many columns there are."""
    wide = T.DecimalType(38, 2)
    return F.aggregate(
        F.array(*(zero_if_null(c).cast(wide) for c in cols)),
        F.lit(0).cast(wide),
        lambda total, amount: (total + amount).cast(wide),
    )


def money_text(col) -> Column:
    """Display form with thousands separators and two decimals."""
    return F.format_number(col, 2)


def percent_text(col) -> Column:
    return F.format_string("%.2f %%", col)
