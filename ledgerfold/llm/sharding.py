"""Two-pass external shuffle of records into shards of equal row counts.

First pass: a seeded hash scatters records uniformly into buckets small enough for memory.
Second pass: the records of each bucket are put in a fixed order, which a Fisher-Yates shuffle
changes; its random numbers are hashes of the seed, the bucket and the step, so the order is the
same wherever and however often the bucket is worked on. A record's place in the whole is the rows
of all earlier buckets plus its place in its own; places are dealt to shards in turn, so that
shards' row counts are at most one apart and each shard is a random sample in random order.

`shuffled_table` takes a table read from files and knows a record by its file and its row there.
Records go to their buckets in one shuffle, are numbered within them, and are written to their
shards from where they are: a bucket's order is computed from its number of rows alone, and only
these orders are sent to the records. Copies of a record are scattered like any others.

`shuffled` takes any rows and knows them by their values: equal ones are counted first and
numbered, buckets hold their numbers, and each whole record is sent to its places.

Nulls hash as themselves; an empty table gives no rows; very long texts are moved whole, and no
array holds them. Columns of `df` named like a new column are replaced; others may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerfold.llm.common import documents, scratch, stored, with_offsets

SHARDS = 16
SEED = 20_011
#: Rows of a bucket, which holds keys of fixed size, however long the records are.
BUCKET_ROWS = 4_096
#: Rows of a bucket of whole records, about.
RECORDS = 512
#: Copies of one record that are expanded at once.
COPIES = 4_096

_OWN = ("law", "shard", "slot", "grown_shard")


def fisher_yates(size: Column, bucket: Column, seed: int) -> Column:
    """A shuffled array of 0 to size - 1: from the last place on, each is swapped with one of the
    places up to it, chosen by a hash."""
    start = F.sequence(F.lit(0), size.cast("int") - 1)
    places = F.reverse(F.sequence(F.lit(1), size.cast("int") - 1))
    swaps = F.transform(
        places,
        lambda i: F.struct(
            i.alias("i"),
            F.pmod(F.xxhash64(F.lit(seed), bucket, i), (i + 1).cast("long")).cast("int").alias("j"),
        ),
    )

    def swap(order: Column, s: Column) -> Column:
        i, j = s["i"], s["j"]
        moved = F.concat(
            F.slice(order, F.lit(1), j),
            F.array(F.get(order, i)),
            F.slice(order, j + 2, i - j - 1),
            F.array(F.get(order, j)),
            F.slice(order, i + 2, F.size(order) - i - 1),
        )
        return F.when(i == j, order).otherwise(moved)

    none = F.array().cast("array<int>")
    return F.when(size < 1, none).when(size == 1, start).otherwise(F.aggregate(swaps, start, swap))


def shuffled(
    df: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """All rows of `df` with `law`, `shard`, `slot` (gapless from 0) and `grown_shard` (null).

    Columns must be comparable; a map column has to be turned into an array of entries first.
    """
    kept = [name for name in df.columns if name not in _OWN]
    counted = df.groupBy(*[F.col(f"`{n}`") for n in kept]).agg(F.count("*").alias("_n"))
    distinct = stored(counted.withColumn("_id", F.monotonically_increasing_id()))
    total = distinct.agg(F.sum("_n")).first()[0] or 0
    buckets = max(1, -(-total // bucket_rows))

    block = F.explode(
        F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPIES).cast("long"))
    ).alias("_block")
    last = F.least(F.col("_n"), (F.col("_block") + 1) * COPIES) - 1
    record = F.struct(*[F.col(f"`{n}`") for n in kept])
    scattered = (
        distinct.select(
            "_id", "_n", F.xxhash64(F.lit(seed), F.to_json(record)).alias("_digest"), block
        )
        .select(
            "_id",
            "_digest",
            "_block",
            F.explode(F.sequence(F.col("_block") * COPIES, last)).alias("_copy"),
        )
        .withColumn("_hash", F.xxhash64("_digest", "_copy"))
        .withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    )
    filled = (
        scattered.groupBy("_bucket")
        .agg(F.array_sort(F.collect_list(F.struct("_hash", "_copy", "_id", "_block"))).alias("_in"))
        .withColumn("_order", fisher_yates(F.size("_in"), F.col("_bucket"), seed))
        .select(
            "_bucket", F.transform("_order", lambda k: F.get(F.col("_in"), k)).alias("_keys")
        )
    )
    sizes = scattered.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    places = (
        filled.join(with_offsets(sizes, "_bucket", "_rows").select("_bucket", "offset"), "_bucket")
        .select("offset", F.posexplode("_keys").alias("_at", "_key"))
        .select("_key._id", "_key._block", (F.col("offset") + F.col("_at")).alias("_place"))
    )
    # A record's copies meet it in blocks, so that one repeated often is not sent out in one task.
    placed = places.join(distinct.select("_id", record.alias("_record"), block), ["_id", "_block"])
    return placed.select(
        *[F.col(f"_record.`{n}`").alias(n) for n in kept],
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shuffled_table(
    table: DataFrame, shards: int = SHARDS, seed: int = SEED, records: int = RECORDS
) -> DataFrame:
    """As `shuffled`, for a table read from files.

    The places depend on the files' names and rows, the seed and the bucket size alone, not on
    how Spark cuts the files or how many tasks there are.
    """
    kept = [name for name in table.columns if name not in _OWN]
    buckets = max(1, -(-table.count() // records))
    at = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    digest = F.xxhash64(F.lit(seed), *at)
    bucket = F.pmod(digest, F.lit(buckets))
    sizes = table.select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count("*").alias("_n"))
    orders = with_offsets(sizes, "_bucket", "_n").select(
        "_bucket", "offset", fisher_yates(F.col("_n"), F.col("_bucket"), seed).alias("_order")
    )
    inside = Window.partitionBy("_bucket").orderBy("_digest", "_file", "_row")
    numbered = table.select(
        F.struct(*[F.col(f"`{n}`") for n in kept]).alias("_record"),
        bucket.alias("_bucket"),
        digest.alias("_digest"),
        at[0].alias("_file"),
        at[1].alias("_row"),
    ).withColumn("_at", F.row_number().over(inside) - 1)
    placed = numbered.join(orders, "_bucket").select(
        "_record", (F.col("offset") + F.get("_order", F.col("_at"))).alias("_place")
    )
    return placed.select(
        *[F.col(f"_record.`{n}`").alias(n) for n in kept],
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in files each of which is in the order of slots.

    Rows are written by the tasks that have them; no task holds a whole shard.
    """
    (
        sharded.sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )


def written(sharded: DataFrame) -> DataFrame:
    """The rows as read from shards in the session's checkpoint folder (see `stored`)."""
    spark = sharded.sparkSession
    path = scratch(spark, "shards")
    write_shards(sharded, path)
    return spark.read.schema(sharded.schema).parquet(path).select(*sharded.columns)


def op6_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffles and writes the whole documents; the rows are digests of what the shards hold."""
    text = F.col("text").cast("string")
    return written(shuffled_table(documents(spark, sf_dir))).select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        *_OWN,
    )
