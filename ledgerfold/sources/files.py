"""Upload files in, finished reports out.

An upload is one or many delimited or Parquet files. Every column is taken by the name
in its own file's header, so a permuted file loads the same as a straight one, and a
file whose header has other names is reported, not guessed at.
"""

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold.operators.joins import join_hot
from ledgerfold.operators.shaping import has_rows
from ledgerfold.schemas import (
    COA_FILE,
    FS_GROUP_FILE,
    INTERCO_FILE,
    TABLES,
    TRIAL_BALANCE_FILE,
)

INVALID_FORMAT = "bad_header"
BYTE_ORDER_MARK = "\ufeff"


@dataclass(frozen=True)
class Upload:
    """Rows of well-formed files, the files turned away, and all well-formed files.

    Rows carry the ``file_name``; those read from files also the ``file_path``, which tells
    files of one name apart, and ``unreadable``: whether a filled cell is no value of its
    column's type. ``files`` has a row for each well-formed file, with rows or without.
    """

    rows: DataFrame
    rejected: DataFrame | None
    files: DataFrame | None = None


def check_header(df: DataFrame, expected: T.StructType) -> bool:
    """The set of column names must be exactly the expected set; reads the schema only."""
    return set(df.columns) == set(expected.names)


def _file_name() -> Column:
    """Name of the file a row came from; Spark hands it out percent-encoded, but for '+'."""
    encoded = F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(encoded).alias("file_name")


def _file_path() -> Column:
    return F.col("_metadata.file_path").alias("file_path")


def _readable(cells: dict[str, Column], expected: T.StructType) -> list[Column]:
    """Each cell as its column's type, and whether any filled one cannot be read as that."""
    values = {f.name: cells[f.name].try_cast(f.dataType) for f in expected}
    lost = F.lit(False)
    for name, value in values.items():
        filled = F.coalesce(F.trim(cells[name].cast("string")) != "", F.lit(False))
        lost = lost | (filled & value.isNull())
    return [*(value.alias(name) for name, value in values.items()), lost.alias("unreadable")]


def read_csv_upload(
    spark: SparkSession, path: str | Sequence[str], expected: T.StructType, sep: str = ","
) -> Upload:
    """Delimited files, each read by its own header line.

    The line holding exactly the expected names is a file's header, and it says which
    position each column has in that file; a file without one is rejected. Headers are
    looked for in the first block of a file alone, and are one row per file, so joining
    them back is small however long the files are.
    """
    width = len(expected)
    # one spare column, so that a file with extra columns shows itself
    raw_schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width + 1)])
    cells = F.array(*(f"c{i}" for i in range(width + 1)))
    names = F.array_sort(F.array(*(F.lit(n) for n in expected.names)))
    raw = (
        spark.read.schema(raw_schema)
        .option("sep", sep)
        .csv(path if isinstance(path, str) else list(path))
        .select(
            _file_name(),
            _file_path(),
            (F.col("_metadata.file_block_start") == 0).alias("first_block"),
            cells.alias("cells"),
        )
    )
    trimmed = F.transform(
        F.array_compact(F.col("cells")), lambda cell: F.trim(F.translate(cell, BYTE_ORDER_MARK, ""))
    )
    is_header = F.col("first_block") & (F.array_sort(trimmed) == names)
    files = raw.groupBy("file_path", "file_name").agg(
        F.max(F.when(is_header, trimmed)).alias("header")
    )
    good = files.where(F.col("header").isNotNull())
    rejected = files.where(F.col("header").isNull()).select(
        "file_name", F.lit(INVALID_FORMAT).alias("reason")
    )
    found = {
        f.name: F.element_at("cells", F.array_position("header", F.lit(f.name)).cast("int"))
        for f in expected
    }
    headers = good.select("file_path", "header")
    rows = join_hot(raw.where(~is_header), headers, ["file_path"], "inner").select(
        *_readable(found, expected), "file_name", "file_path"
    )
    return Upload(rows, rejected, good.select("file_path", "file_name"))


_NO_CELL = (T.StructType, T.ArrayType, T.MapType, T.BinaryType, T.VariantType)
_NO_FOOTER = ("CANNOT_READ_FILE_FOOTER", "is not a Parquet file", "UNABLE_TO_INFER_SCHEMA")
_GLOB = str.maketrans({c: f"\\{c}" for c in "\\{}[]*?"})


def _schema_of(spark: SparkSession, path: str) -> T.StructType | None:
    """A Parquet file's own schema, from its footer; None if the file is no Parquet."""
    try:
        return spark.read.parquet(path.translate(_GLOB)).schema
    except (PySparkException, Py4JJavaError) as error:
        if any(reason in str(error) for reason in _NO_FOOTER):
            return None
        raise


def read_parquet_upload(spark: SparkSession, path: str, expected: T.StructType) -> Upload:
    """Parquet files, each judged by the names in its own footer, whatever its values.

    Files are grouped by their schemas and each group is read with its own, so that a column of
    another type in one file is that file's matter: its cells are cast, and reject the file if
    they cannot be. A file of other names without rows has nothing to reject, as the empty part
    that a writer leaves beside the others, and is passed over. Footers are read one by one, some at a time; files are few beside their rows.
    """
    listed = (
        spark.read.format("binaryFile").load(path).select("path", _file_name(), _file_path())
    ).collect()  # names only: the content is not read
    with ThreadPool(8) as pool:
        schemas = pool.map(lambda row: _schema_of(spark, row.path), listed)
    groups, bad, good = defaultdict(list), [], []
    for row, schema in zip(listed, schemas, strict=True):
        cells = schema is not None and not any(isinstance(f.dataType, _NO_CELL) for f in schema)
        if not cells or set(schema.names) != set(expected.names):
            if schema is None or has_rows(spark.read.parquet(row.path.translate(_GLOB))):
                bad.append((row.file_name, INVALID_FORMAT))
        else:
            good.append((row.file_path, row.file_name))
            groups[tuple(sorted((f.name, f.dataType.simpleString()) for f in schema))].append(
                (row.path, schema)
            )
    names = "file_path string, file_name string"
    rejected = spark.createDataFrame(bad, "file_name string, reason string")
    rows = None
    for members in groups.values():
        paths = [own.translate(_GLOB) for own, _ in members]
        df = spark.read.schema(members[0][1]).parquet(*paths)
        found = {f.name: F.col(f"`{f.name}`") for f in expected}
        part = df.select(*_readable(found, expected), _file_name(), _file_path())
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        schema = T.StructType([*expected.fields, T.StructField("unreadable", T.BooleanType())])
        rows = spark.createDataFrame([], schema).selectExpr("*", "'' file_name", "'' file_path")
    return Upload(rows, rejected, spark.createDataFrame(good, names))


def read_upload(spark: SparkSession, path: str, expected: T.StructType, fmt: str = "csv") -> Upload:
    reader = {"csv": read_csv_upload, "parquet": read_parquet_upload}[fmt]
    return reader(spark, path, expected)


def read_tb(spark: SparkSession, path: str, fmt: str = "csv") -> Upload:
    """Trial-balance files; the account name is checked for and then left behind."""
    upload = read_upload(spark, path, TRIAL_BALANCE_FILE, fmt)
    return Upload(upload.rows.drop("account_name"), upload.rejected, upload.files)


def read_interco(spark: SparkSession, path: str, fmt: str = "csv") -> Upload:
    """Intercompany files; the account name is checked for and then left behind."""
    upload = read_upload(spark, path, INTERCO_FILE, fmt)
    return Upload(upload.rows.drop("account_name"), upload.rejected, upload.files)


def _read_by_position(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_coa(spark: SparkSession, path: str) -> DataFrame:
    """Chart of accounts: columns by position, header names ignored."""
    return _read_by_position(spark, path, COA_FILE)


def read_fs_group(spark: SparkSession, path: str) -> DataFrame:
    """Statement grouping: columns by position, header names ignored."""
    return _read_by_position(spark, path, FS_GROUP_FILE)


def read_table(spark: SparkSession, path: str, name: str, *columns: str) -> DataFrame:
    """A stored table with its declared schema, cut to the columns asked for."""
    table = spark.read.schema(TABLES[name]).parquet(path)
    return table.select(*columns) if columns else table


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Export a finished report as delimited text with a header, or as Parquet."""
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_periods(df: DataFrame, path: str) -> None:
    """Put the given periods in the place of the same periods of a stored fact.

    Periods that have no row in ``df`` stay as they are.
    """
    df.hint("rebalance", F.col("period_code")).write.partitionBy("period_code").mode(
        "overwrite"
    ).option("partitionOverwriteMode", "dynamic").parquet(path)


def write_facts(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store a fact by period, so that a report of one period reads that period only.

    The rebalance hint lets a period holding much of the data be written by many tasks,
    and keeps small periods from being scattered over many files.
    """
    df.hint("rebalance", F.col("period_code")).write.partitionBy("period_code").mode(mode).parquet(
        path
    )
