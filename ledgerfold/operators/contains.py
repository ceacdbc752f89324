"""Search for a text within a column through an index of its three-character pieces.

The index is a stored table of postings (column, piece, key). Each task writes the postings of its
own rows to a file, in order of column and piece, so that no posting is shuffled, and a search
reads the few pages of its own pieces in each file. Candidates have all the pieces looked up, and
are then compared with the text itself; the result is that of a scan. A text of fewer than three
characters has no piece and scans.

A piece that very many rows have is spread over many files as the rows are, and the candidates
are counted by key, so it makes no task larger than others. A search takes the pieces that the
fewest rows have.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions import contains_ci
from ledgerfold.operators.joins import join_hot

#: Characters of a piece, and pieces that a search looks up at most.
SIZE, PIECES = 3, 4
#: Postings that a task sorts or counts, about.
POSTINGS = 1_000_000
#: Bytes of a row group of postings.
ROW_GROUP = 8 << 20


def pieces(text: Column) -> Column:
    """The distinct pieces of a text in small letters, none of a short or missing one."""
    small = F.lower(text)
    starts = F.sequence(F.lit(1), F.length(small) - (SIZE - 1))
    none = F.array().cast("array<string>")
    own = F.array_distinct(F.transform(starts, lambda k: F.substr(small, k, F.lit(SIZE))))
    return F.when(F.length(small) >= SIZE, own).otherwise(none)


def _parts(postings: int | None) -> int:
    """Tasks to which so many postings are dealt."""
    return max(1, -(-(postings or 0) // POSTINGS))


def write_index(df: DataFrame, path: str, key: str, columns: Sequence[str]) -> None:
    """Store the postings of the columns' texts, and how many rows have each piece.

    The lengths of the texts tell how many tasks to deal the rows to, however few bytes they
    have, before they are cut into pieces. A task sorts about as many postings as others.
    """
    texts = df.select(
        F.col(key).alias("key"), *(F.lower(c).alias(f"_{n}") for n, c in enumerate(columns))
    )
    names = texts.columns[1:]
    most = texts.agg(
        *(F.sum(F.greatest(F.length(n) - (SIZE - 1), F.lit(0))).alias(n) for n in names)
    ).first()
    parts = _parts(sum(n or 0 for n in most))
    dealt = texts.repartition(parts, *texts.columns)
    start, text = F.col("start"), F.col("text")
    postings = reduce(
        DataFrame.unionByName,
        [
            dealt.where(F.length(n) >= SIZE)
            .select("key", F.col(n).alias("text"))
            .select("*", F.explode(F.sequence(F.lit(1), F.length("text") - (SIZE - 1))).alias("start"))
            .select(
                F.lit(c).alias("column_name"),
                F.substr(text, start, F.lit(SIZE)).alias("piece"),
                "key",
                "text",
                "start",
            )
            .where(F.instr(text, F.col("piece")) == start)
            .drop("text", "start")
            for n, c in zip(names, columns, strict=True)
        ],
    )
    (
        postings.sortWithinPartitions("column_name", "piece")
        .write.option("parquet.block.size", ROW_GROUP)
        .parquet(f"{path}/postings")
    )
    stored = df.sparkSession.read.parquet(f"{path}/postings")
    counts = stored.groupBy("column_name", "piece").agg(F.count(F.lit(1)).alias("rows"))
    counts.write.parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, column: str, text: str) -> DataFrame | None:
    """Keys of the rows that have the text's rarest pieces; None where it is too short."""
    own = spark.range(1).select(pieces(F.lit(text))).first()[0]
    if not own:
        return None
    in_column = F.col("column_name") == column
    counts = dict(
        spark.read.parquet(f"{path}/counts")
        .where(in_column & F.col("piece").isin(own))
        .select("piece", "rows")
        .collect()  # a row for each piece of the text
    )
    rarest = sorted(own, key=lambda piece: (counts.get(piece, 0), piece))[:PIECES]
    postings = spark.read.parquet(f"{path}/postings").where(in_column & F.col("piece").isin(rarest))
    # a file holds many postings of few bytes: keys are dealt before they are counted, and a bit
    # for each piece tells whether a key has them all
    bits = reduce(
        lambda rest, k: F.when(F.col("piece") == rarest[k], 1 << k).otherwise(rest),
        range(len(rarest)),
        F.lit(0),
    )
    dealt = postings.select("key", bits.alias("_bits")).repartition(
        _parts(sum(counts.get(piece, 0) for piece in rarest)), "key"
    )
    found = dealt.groupBy("key").agg(F.bit_or("_bits").alias("_bits"))
    return found.where(F.col("_bits") == (1 << len(rarest)) - 1).select("key")


def search(df: DataFrame, path: str, key: str, column: str, text: str) -> DataFrame:
    """Rows whose column contains the text, in any case of letters, as a scan would find them."""
    found = candidates(df.sparkSession, path, column, text)
    if found is not None:
        df = join_hot(df, found.withColumnRenamed("key", key), [key], "left_semi")
    return df.where(contains_ci(column, text))
