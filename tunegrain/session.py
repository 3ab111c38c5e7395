"""Session defaults and the shared work folder.

Intermediate tables are written as Parquet under the folder the cluster names in
``spark.checkpoint.dir``: a lost executor then costs a re-read, not a recomputed
lineage. A machine-local folder is used only when Spark itself runs in local mode.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tunegrain", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Of repeated keys in a JSON object the last one counts.
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        # Recording a call site for every Column operation slows down building large plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, without a trailing slash."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tunegrain-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path below the shared folder."""
    return f"{shared_folder(spark)}/tunegrain/{label}-{uuid.uuid4().hex}"


SHUFFLE_BYTES = 512 * 1024**2
MOST_PARTITIONS = 65_536
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def planned_bytes(df: DataFrame) -> int:
    """Size of a frame as the optimizer sees it (file sizes for a plain scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fit_shuffles(df: DataFrame) -> DataFrame:
    """Let shuffles start with enough partitions for this input; only ever raises the number.

    Adaptive execution merges small partitions but never adds any, so the starting number has
    to follow the data. Small inputs keep the session's own setting.
    """
    spark = df.sparkSession
    wanted = min(MOST_PARTITIONS, -(-planned_bytes(df) // SHUFFLE_BYTES))
    current = int(spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if wanted > current:
        spark.conf.set(INITIAL_PARTITIONS, str(wanted))
    return df


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 * 1024**2


def bound_batches(df: DataFrame) -> DataFrame:
    """Let texts go to Python in small Arrow batches, whoever writes the frame; only ever lowers the bound.

    A batch stands several times in memory, in the executor and in its Python worker, and neither gives back all of it.
    """
    spark = df.sparkSession
    current = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(ARROW_BYTES)))
    if current <= 0 or current > BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    return df


#: Bytes of input that one file of a table written in another format takes.
FILE_BYTES = 64 * 1024**2


def files_for(df: DataFrame, least: int) -> int:
    """How many files a frame is written to: ``least``, or more so that no task has much more than FILE_BYTES to read."""
    return max(least, -(-planned_bytes(df) // FILE_BYTES))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back, so that later passes skip its lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
