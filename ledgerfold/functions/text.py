"""Text matching and cleaning."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerfold.schemas import FILE_NAME_PUNCTUATION, UNMAPPED


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_file_name(col) -> Column:
    """Punctuation to underscores; dots and dashes survive."""
    return F.translate(_col(col), FILE_NAME_PUNCTUATION, "_" * len(FILE_NAME_PUNCTUATION))


def contains_ci(col, text: str) -> Column:
    """Case-insensitive contains; wildcards in the text are taken literally."""
    literal = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return _col(col).ilike(f"%{literal}%")


def title_case(col) -> Column:
    """Names as they are greeted: every word with a capital."""
    return F.initcap(_col(col))


def equals_ci(left, right) -> Column:
    return F.lower(_col(left)) == F.lower(_col(right))


def or_unmapped(col) -> Column:
    return F.coalesce(_col(col), F.lit(UNMAPPED))
