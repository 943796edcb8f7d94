"""Running a stream over the files that are there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from framekiln.session import fresh_path
from framekiln.sources.tar import TASKS_PER_CORE


def drain(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> None:
    """Append all available input to a Parquet table and stop.

    Running it again with the same checkpoint goes on with new files only; the file
    sink's log makes every micro-batch count once, also after a restart. The rows of a
    ``partition_by`` folder go to one task and folders are spread over tasks, whoever dealt the rows.
    """
    if partition_by:
        stream = stream.repartition(TASKS_PER_CORE * stream.sparkSession.sparkContext.defaultParallelism, *partition_by)
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def drained(spark: SparkSession, stream: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """The table that ``drain`` makes, in the shared folder."""
    path = fresh_path(spark, label)
    drain(stream, f"{path}/table", f"{path}/checkpoint", partition_by)
    return spark.read.schema(stream.schema).parquet(f"{path}/table")
