"""Session settings and the folder that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local_dir: str | None = None
# What an Arrow batch that goes to Python may hold, unless one row alone has more.
ARROW_BYTES = 8 << 20


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps.

    On a cluster leave ``master`` and ``shuffle_partitions`` to the submit command;
    the local values are for tests and for ``bench.py``.
    """
    builder = (
        SparkSession.builder.appName("framekiln")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Let no batch that goes to Python outgrow a task's memory, however long its rows are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may go without it: there a fresh temporary folder is
    reachable by all threads. On a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    global _local_dir
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="framekiln-")
    return _local_dir


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/framekiln/{label}-{uuid.uuid4().hex}"


def written(df, label: str, partition_by: list[str] | None = None):
    """Cut lineage by writing ``df`` as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
