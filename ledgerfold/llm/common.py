"""Helpers shared by the text operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space between words, as in the pattern `[^\x20\x09-\x0D]+` for a word.
BLANKS = " \t\n\x0b\f\r"

_shipped: weakref.WeakSet = weakref.WeakSet()


def shipped(spark: SparkSession) -> None:
    """Send this package to the executors, once for each session, unless they can import it.

    They can where it is installed or named in PYTHONPATH, or lies in the working folder.
    """
    root = Path(__file__).resolve().parents[2]
    places = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    context = spark.sparkContext
    if "site-packages" in root.parts or any(p and Path(p).resolve() == root for p in places):
        return
    if context not in _shipped:
        archive = Path(tempfile.mkdtemp(prefix="package-")) / "ledgerfold_package.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted((root / "ledgerfold").rglob("*.py")):
                out.write(path, path.relative_to(root))
        context.addPyFile(str(archive))
        _shipped.add(context)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of a key written as text, modulo `modulus`; a missing key counts as empty text."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the session's checkpoint folder (see `stored`)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write rows to the session's checkpoint folder and read them back.

    The lineage ends there, so a lost executor costs no step before it. The folder is the one
    in `spark.checkpoint.dir`, shared by all executors; only where none is set, as in tests,
    a temporary one is taken. Files stay until the folder is cleaned, as checkpoints do.
    """
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: as `stored`, for small tables in a loop."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def with_offsets(counts: DataFrame, key: str, count: str, span: int = 4096) -> DataFrame:
    """Add `offset`: the sum of `count` over all smaller values of the integer `key`.

    Keys are summed in blocks of `span` first, so one task holds blocks or one block only.
    """
    blocked = counts.withColumn("_block", F.floor(F.col(key) / span))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocked.groupBy("_block")
        .agg(F.sum(count).alias("_total"))
        .select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.join(blocks, "_block")
        .withColumn("offset", F.col("_base") + F.coalesce(F.sum(count).over(inside), F.lit(0)))
        .drop("_block", "_base")
    )
