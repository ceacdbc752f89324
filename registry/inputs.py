"""Shared inputs of the registered queries."""

from pyspark.sql import DataFrame, SparkSession

from ledgerfold.operators.shaping import decimals_as_double
from ledgerfold.sources.star_schema import StarSchemaBooks

PARENT = "C00"
PERIOD = "Q1_1997"

_opened: dict[tuple[SparkSession, str], StarSchemaBooks] = {}


def books(spark: SparkSession, sf_dir: str) -> StarSchemaBooks:
    """The derived tables of a folder. Only their definitions are kept, never their rows."""
    key = (spark, sf_dir)
    if key not in _opened:
        _opened[key] = StarSchemaBooks(spark, sf_dir)
    return _opened[key]


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, cast once after all sums, as the SQL does."""
    return decimals_as_double(df)


COMPANY_CODES = [f"C{n:02d}" for n in range(25)]
GROUP_CODES = {f"C{p:02d}": [f"C{n:02d}" for n in range(p, 25, 5)] for p in range(5)}
