"""Consecutive numbers and places, without ever sorting a whole group or table in one task."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerfold.session import scratch

BUCKET_BITS = 20
BLOCK_BITS = 42
# Spark's row ids hold the partition above so many bits, and the row's place in it below.
ROW_BITS = 33


def number_within(df: DataFrame, group: Sequence[str], order_key: str, name: str) -> DataFrame:
    """Number rows 1, 2, 3, ... within each group in the order of a unique integer key.

    A plain window would put a group holding a third of all rows into one task. Here the
    key's high bits cut each group into buckets of at most 2**20 keys, in order. Rows are
    numbered within their bucket, and the rows of all earlier buckets are added: counted
    per bucket, then summed up over at most 2**22 buckets of a block, then over at most
    2**22 blocks of a group. No window sees more rows than that, whatever the skew, and
    the outcome depends on the keys alone.

    Group, block and bucket travel as structs, which compare equal where a part is null.
    """
    key = F.col(order_key).cast("bigint")
    block = F.shiftright(key, BLOCK_BITS).alias("n")
    bucket = F.shiftright(key, BUCKET_BITS).alias("n")
    of_group = F.struct(*group).alias("_group")
    of_block = F.struct(of_group, block).alias("_block")
    bucketed = df.withColumn("_bucket", F.struct(of_block, bucket))

    def earlier(parent: str, order: str) -> Column:
        before = W.partitionBy(parent).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum("_rows").over(before), F.lit(0))

    buckets = (
        bucketed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_block", F.col("_bucket._block"))
    )
    blocks = (
        buckets.groupBy("_block")
        .agg(F.sum("_rows").alias("_rows"))
        .withColumn("_group", F.col("_block._group"))
    )
    before_block = blocks.select("_block", earlier("_group", "_block.n").alias("_before_block"))
    offsets = (
        buckets.select("_bucket", "_block", earlier("_block", "_bucket.n").alias("_before"))
        .join(before_block, "_block")
        .select("_bucket", (F.col("_before") + F.col("_before_block")).alias("_before"))
    )
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy(key))
    return (
        bucketed.withColumn("_rank", rank)
        .join(offsets, "_bucket")
        .withColumn(name, F.col("_rank") + F.col("_before"))
        .drop("_bucket", "_rank", "_before")
    )


def with_position(df: DataFrame, keys: Sequence, name: str = "position") -> DataFrame:
    """Add each row's place, from 1, in the order of any keys; '-' before a name: descending.

    The rows are dealt to ranges of the order, sorted there, and put aside with their place in
    their range, so that reading them again cannot deal them otherwise. Counting each range gives
    the places before it, one number for each partition, which is all that the driver sees.
    Rows equal in all keys follow each other in the order of a hash of the row; rows equal in all
    columns are told apart by where they were read, so no key is too large for a range.
    """
    order = [
        F.desc(key[1:]) if isinstance(key, str) and key.startswith("-") else key for key in keys
    ]
    spread = [F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.monotonically_increasing_id()]
    tied = df.withColumns({"_hash": spread[0], "_read": spread[1]})
    path = scratch(df.sparkSession, "ordered")
    (
        tied.repartitionByRange(*order, "_hash", "_read")
        .sortWithinPartitions(*order, "_hash", "_read")
        .drop("_hash", "_read")
        .withColumn("_at", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    rows = df.sparkSession.read.parquet(path)
    part = F.shiftright("_at", ROW_BITS).cast("int")
    counts = dict(rows.groupBy(part).agg(F.count(F.lit(1))).collect())
    before, total = [], 0
    for k in range(max(counts, default=0) + 1):
        before.append(total)
        total += counts.get(k, 0)
    earlier = F.get(F.array(*(F.lit(n).cast("bigint") for n in before)), part)
    inside = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return rows.withColumn(name, earlier + inside + 1).drop("_at")
