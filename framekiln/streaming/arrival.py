"""Shards that arrive in a folder, as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framekiln.sources.tar import SCHEMA, SPLIT_BYTES, TASKS_PER_CORE, TarReader, TarSplit

READ_AHEAD = 4
# What shards a micro-batch takes; a larger shard makes one by itself.
TRIGGER_BYTES = 1 << 30


def arriving_rows(spark: SparkSession, path: str, schema, max_files: int = READ_AHEAD) -> DataFrame:
    """New Parquet files of a folder, a few per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def arriving_shards(
    spark: SparkSession,
    path: str,
    fields: list[str] | None = None,
    sizes: bool = False,
    max_files: int | None = None,
    split_bytes: int = SPLIT_BYTES,
    bad_samples: str = "keep",
    required: list[str] | None = None,
    max_bytes: int = TRIGGER_BYTES,
) -> DataFrame:
    """Samples of new tar shards in a folder, as ``tar_scan`` gives them; its ``bad_samples`` may be ``drop`` or ``only`` too.

    The file source keeps the list of shards in its checkpoint and takes about ``max_bytes`` of them per micro-batch, oldest first, so
    the number of micro-batches follows the bytes and not the number of shards; ``max_files`` counts shards instead. A stream
    reader in Python would have to take all new shards at once, as Spark gives it no limit.

    Only names and lengths of the files travel; the tasks read the shards, large ones
    in several pieces. ``shard_idx`` is the number in the file name.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "*.tar")
        .option("maxBytesPerTrigger" if max_files is None else "maxFilesPerTrigger", max_bytes if max_files is None else max_files)
        .load(path)
    )
    number = F.regexp_extract("path", r"(\d+)\.tar$", 1)
    begins = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    splits = files.select(
        "path",
        F.when(number != "", number).cast("int").alias("shard_idx"),
        F.explode(begins).alias("begin"),
        "length",
    )
    # Pieces of one large shard go to different tasks. Their rows are narrow: without a number adaptive execution would put all into one.
    splits = splits.repartition(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, "path", "begin")
    options = {
        "path": "",
        "fields": "*" if fields is None else ",".join(fields),
        "sizes": str(sizes),
        "required": ",".join(required or []),
    }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TarReader(options)
        for batch in batches:
            for row in batch.to_pylist():
                end = min(row["begin"] + split_bytes, row["length"])
                yield from reader.read(TarSplit(row["path"], row["shard_idx"], row["begin"], end))

    rows = splits.mapInArrow(read, SCHEMA)
    if bad_samples == "drop":
        return rows.filter("_error IS NULL")
    return rows.filter("_error IS NOT NULL") if bad_samples == "only" else rows
