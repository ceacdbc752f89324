"""A local session for tests and the bench, and the folder for tables that are put aside."""

import tempfile
import uuid

from pyspark.sql import SparkSession


# At test scale the largest fact is only a few megabytes once its columns are pruned, and
# Spark's default threshold would broadcast it. A lower one gives the plans of a cluster.
BROADCAST_LIMIT = "2m"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerfold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", BROADCAST_LIMIT)
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of `spark.checkpoint.dir`, which all executors share.

    Only where none is set, as in tests on one machine, a temporary folder becomes that folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
