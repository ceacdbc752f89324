"""Timestamps to text. Casting to string reads the wall clock of either timestamp
type, so these results do not move with the session time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def minute_of(ts) -> Column:
    """Timestamp cut to the minute, its type kept."""
    ts = _col(ts)
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.extract(F.lit("second"), ts))


def date_text(ts) -> Column:
    return _col(ts).cast("date").cast("string")


def time_text(ts) -> Column:
    return F.substring(_col(ts).cast("string"), 12, 8)


def timestamp_text(ts) -> Column:
    return F.substring(_col(ts).cast("string"), 1, 19)


def date_label(day) -> Column:
    """1 Jan 2024"""
    return F.date_format(day, "d MMM yyyy")


def minute_label(ts) -> Column:
    """1 Jan 2024 13:05"""
    return F.date_format(ts, "d MMM yyyy HH:mm")
