"""Joins of a table whose keys may be hot with a table of one row per key."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_hot(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join so that Spark can split a key holding much of the left table over many tasks.

    The adaptive skew join splits a partition only where both inputs come straight out of
    a shuffle. A right side just aggregated or joined by the same keys is partitioned as
    needed already, and would be taken without one. A hash of the keys as one more join
    key has it shuffled for this join, small as it is, and changes no match. Where either
    side turns out small enough, Spark broadcasts it instead, as for any join.
    """
    spread = F.xxhash64(*keys)
    joined = left.withColumn("_spread", spread).join(
        right.withColumn("_spread", spread), [*keys, "_spread"], how
    )
    # a semi or anti join leaves the columns where they were
    return joined.select(*left.columns) if how in ("left_semi", "left_anti") else joined.drop("_spread")
