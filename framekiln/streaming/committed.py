"""Streaming sinks whose batches count once: a table that takes updates, and tar shards.

Tasks write under names of their own; a batch counts from the moment its manifest, named by the batch's number, is there. A batch
that Spark runs again after a failure finds its manifest and leaves no second trace; what a killed batch wrote has
no manifest and is never read.
"""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from framekiln.sources import tar


def _manifest(batch: int) -> str:
    return f"commits/{batch:012d}.json"


def _write_file(store, path: str, data: bytes) -> None:
    """A file that is there in whole or not at all."""
    hidden = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        out.write(data)
    store.move(hidden, path)


def committed(path: str) -> dict[int, list]:
    """What each committed batch of a sink lists, by number."""
    store, folder = tar.open_store(path)
    found = {}
    for info in store.get_file_info(pafs.FileSelector(f"{folder}/commits", allow_not_found=True)):
        name = info.base_name
        if info.is_file and name.endswith(".json") and not name.startswith("."):
            with store.open_input_file(info.path) as file:
                found[int(name[: -len(".json")])] = json.loads(file.read())
    return dict(sorted(found.items()))


@dataclass
class Written(WriterCommitMessage):
    entries: list


class _CommittedWriter(DataSourceStreamArrowWriter):
    """Commit and abort of both sinks; an entry begins with the name of a file that a task wrote."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.path = options["path"].rstrip("/")
        self.names = schema.names

    def _finish(self, store, folder: str, entries: list) -> list:
        """Makes files final; returns what the manifest lists."""
        return entries

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803 - Spark's name
        store, folder = tar.open_store(self.path)
        store.create_dir(f"{folder}/commits", recursive=True)
        if store.get_file_info(f"{folder}/{_manifest(batchId)}").is_file:
            self.abort(messages, batchId)  # the batch ran before
            return
        entries = [entry for message in messages if message for entry in message.entries]
        listed = self._finish(store, folder, entries)
        _write_file(store, f"{folder}/{_manifest(batchId)}", json.dumps(listed).encode())

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        store, folder = tar.open_store(self.path)
        for message in messages:
            for entry in message.entries if message else []:
                if store.get_file_info(f"{folder}/{entry[0]}").is_file:
                    store.delete_file(f"{folder}/{entry[0]}")


class _UpdateWriter(_CommittedWriter):
    """One Parquet file per task, with rows that have come or changed."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = tar.open_store(self.path)
        name, out, rows = f"parts/{uuid.uuid4().hex}.parquet", None, 0
        store.create_dir(f"{folder}/parts", recursive=True)
        try:
            for batch in iterator:
                if batch.num_rows:
                    out = out or pq.ParquetWriter(f"{folder}/{name}", batch.schema, filesystem=store)
                    out.write_batch(batch)
                    rows += batch.num_rows
        finally:
            if out:
                out.close()
        return Written([[name, rows]] if rows else [])


class UpdateTable(DataSource):
    """A sink of changed rows; see ``run_updates`` and ``latest_rows``."""

    @classmethod
    def name(cls) -> str:
        return "updatetable"

    def streamWriter(self, schema: StructType, overwrite: bool) -> _UpdateWriter:  # noqa: N802
        return _UpdateWriter(dict(self.options), schema)


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append all available changes, such as ``step_updates`` gives, to the update table at ``path``, and stop.

    A micro-batch must not hold two rows of one key. Running it again with the same checkpoint goes on with new input.
    """
    stream.sparkSession.dataSource.register(UpdateTable)
    writer = stream.writeStream.format("updatetable").option("path", path).option("checkpointLocation", checkpoint)
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def latest_rows(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key in the committed batches of an update table."""
    files = [(entry[0].rpartition("/")[2], batch) for batch, entries in committed(path).items() for entry in entries]
    if not files:
        return spark.createDataFrame([], schema)
    named = spark.createDataFrame(files, "__file string, __batch long")
    rows = spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/parts/{name}" for name, _ in files])
    rows = rows.select(*schema.names, F.col("_metadata.file_name").alias("__file")).join(named, "__file")
    values = F.struct(*[F.col(n) for n in schema.names if n not in keys])
    newest = rows.groupBy(*keys).agg(F.max_by(values, "__batch").alias("v"))
    return newest.select(*[F.col(n) if n in keys else F.col("v")[n].alias(n) for n in schema.names])


def compact_updates(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], out: str) -> None:
    """The newest rows as a plain Parquet table."""
    latest_rows(spark, path, schema, keys).write.mode("overwrite").parquet(out)


class _ShardWriter(_CommittedWriter):
    """Whole shards from narrow rows: a task reads the members of its samples in place and writes them in order."""

    def __init__(self, options: dict, schema: StructType) -> None:
        super().__init__(options, schema)
        self.fields = [f for f in options["fields"].split(",") if f]
        self.key = options["key"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = tar.open_store(self.path)
        rows = [row for batch in iterator for row in batch.select(["target", "slot", "shard", "pos", self.key]).to_pylist()]
        rows.sort(key=lambda row: (row["target"], row["slot"]))
        reader, opened, stream = tar._Samples(set(self.fields), False), None, None
        entries, archive, out = [], None, None
        for i, row in enumerate(rows):
            if not i or row["target"] != rows[i - 1]["target"]:
                if archive:
                    archive.close()
                    out.close()
                name = f"{row['target'].rpartition('/')[0]}/.{uuid.uuid4().hex}.tar.part".lstrip("/")
                store.create_dir(f"{folder}/{name}".rpartition("/")[0], recursive=True)
                entries.append([name, row["target"], 0])
                out = store.open_output_stream(f"{folder}/{name}")
                archive = tarfile.open(fileobj=out, mode="w|")
            if row["shard"] != opened:
                if stream:
                    stream.close()
                source, inside = tar.open_store(row["shard"])
                opened, stream = row["shard"], source.open_input_file(inside)
            bodies = reader.at(stream, row["pos"] * tar.BLOCK)
            for ext in self.fields:
                if ext in bodies:
                    info = tarfile.TarInfo(f"{row[self.key]}.{ext}")
                    info.size = len(bodies[ext])
                    archive.addfile(info, io.BytesIO(bodies[ext]))
            entries[-1][2] += 1
        if archive:
            archive.close()
            out.close()
        if stream:
            stream.close()
        return Written(entries)

    def _finish(self, store, folder: str, entries: list) -> list:
        # A batch that runs again makes the same shards, so a name is replaced by its equal.
        for hidden, target, _ in entries:
            store.move(f"{folder}/{hidden}", f"{folder}/{target}")
        return [[target, rows] for _, target, rows in entries]


class ShardSink(DataSource):
    """A sink of tar shards; see ``stream_to_shards``."""

    @classmethod
    def name(cls) -> str:
        return "tarshardsink"

    def streamWriter(self, schema: StructType, overwrite: bool) -> _ShardWriter:  # noqa: N802
        return _ShardWriter(dict(self.options), schema)


def stream_to_shards(whole: DataFrame, path: str, checkpoint: str, fields: Sequence[str], rank: str = "rank", digits: int = 6) -> None:
    """Write all available whole shards as ``rank-%05d/shard-%06d.tar``, and stop.

    ``whole`` has rows of whole shards: the ``rank``, ``batch_no`` (the shard's number), ``slot`` (its place there), and ``shard`` and ``pos`` of
    the sample that is read; ``stream_bucket_batches`` makes such rows of narrow ones, with less than a shard of each rank in its
    state. Image bytes go from the source to the new shard inside one task.
    """
    from framekiln.functions.fields import rekey

    spark = whole.sparkSession
    spark.dataSource.register(ShardSink)
    target = F.format_string("rank-%05d/shard-%06d.tar", F.col(rank), F.col("batch_no"))
    rows = whole.select(target.alias("target"), "slot", "shard", "pos", rekey(F.col("slot"), digits).alias("key"))
    rows = rows.repartition(tar.TASKS_PER_CORE * spark.sparkContext.defaultParallelism, "target")
    writer = rows.writeStream.format("tarshardsink").option("path", path).option("fields", ",".join(fields)).option("key", "key")
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
