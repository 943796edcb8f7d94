"""Tar shards of samples as a Spark data source.

``spark.read.format("tarshards")`` gives one row per sample: the consecutive members
that share a name up to the first dot of the file name. Options:

``path``          files, folders or globs, separated by commas; also any URI that
                  Arrow's file systems read, such as
                  ``s3://bucket/folder?endpoint_override=host``, and ``http(s)`` URLs of
                  files on servers that answer byte ranges
``fields``        extensions whose bytes are wanted, separated by commas; the bodies
                  of other members are skipped, not read. ``*`` is all, empty is none.
                  The columns ``members`` (extensions) and ``bytes`` cover all members
                  in any case
``sizes``         ``true`` reads image sizes from header bytes
``splitBytes``    shards larger than this are read by several tasks, each of which skips
                  through the headers before its part
``ignoreMissing`` ``true`` skips listed paths that do not exist
``required``      extensions, separated by commas; samples that lack one are skipped, and
                  their bodies are not read
``shards``        a JSON list of shard numbers; other shards are not opened
``keyPrefixes``   a JSON list of beginnings of keys; bodies of other samples are not read
``packBytes``     small shards share a task until it has this many bytes, each counted with ``OPEN_BYTES`` for opening it;
                  without it every shard has a task of its own
``leastTasks``    how many tasks a scan keeps where packing would leave fewer

These last three are options, and the reader has no ``pushFilters``: Spark 4.1 keeps the filters that one query has pushed into a
Python source for all later ones of the same DataFrame, so a count after a filtered count would be wrong.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
import tarfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from framekiln.functions.fields import IMAGE_EXTENSIONS
from framekiln.functions.images import header_size
from framekiln.sources.ranges import HttpStore

SCHEMA = (
    "shard string, shard_idx int, pos bigint, key string, members array<string>, bytes bigint, "
    "fields map<string, binary>, height int, width int, _error string"
)
_ARROW = pa.schema(
    [
        ("shard", pa.string()),
        ("shard_idx", pa.int32()),
        ("pos", pa.int64()),
        ("key", pa.string()),
        ("members", pa.list_(pa.string())),
        ("bytes", pa.int64()),
        ("fields", pa.map_(pa.string(), pa.binary())),
        ("height", pa.int32()),
        ("width", pa.int32()),
        ("_error", pa.string()),
    ]
)
BLOCK = tarfile.BLOCKSIZE
SPLIT_BYTES = 1 << 30
# What one task should fetch and encode or write.
TASK_BYTES = 512 << 20
# What small shards make up one task of a scan, and what opening a shard counts as.
PACK_BYTES = 64 << 20
OPEN_BYTES = 1 << 20
TASKS_PER_CORE = 4
# Positions in a shard count 512-byte units, so row numbering should cut its blocks
# this wide: one block holds the samples of at most one split's worth of bytes.
BLOCK_UNITS = SPLIT_BYTES // BLOCK
# A batch goes to Spark when it has this many rows or bytes.
BATCH_ROWS = 512
BATCH_BYTES = 32 << 20
HEADER_BYTES = 1 << 16
MOVES_AT_ONCE = 32


def open_store(path: str) -> tuple[pafs.FileSystem | HttpStore, str]:
    """The Arrow file system of a path or URI, and the path inside it; for ``http(s)`` a store of range requests."""
    if path.startswith(("http://", "https://")):
        return HttpStore(), path
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    if "://" in path:
        # Spark's name for the S3 connector.
        return pafs.FileSystem.from_uri("s3" + path[len("s3a") :] if path.startswith("s3a://") else path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def listed(path: str) -> list[tuple[str, int, str]]:
    """(path, size, version) of the tar files at a file, folder or glob; empty when missing.

    The version is the time of the last change, or what a server names as such. A URL is one file.
    """
    if path.startswith(("http://", "https://")):
        try:
            return [(path, *open_store(path)[0].stat(path))]
        except FileNotFoundError:
            return []
    base, mark, query = path.partition("?") if "://" in path else (path, "", "")
    pattern = base.rsplit("/", 1)[-1]
    globbed = any(c in pattern for c in "*?[")
    if globbed:
        base = base[: -len(pattern)].rstrip("/")
    store, inside = open_store(base + mark + query)
    prefix = base[: len(base) - len(inside)] if base.endswith(inside) else ""
    info = store.get_file_info(inside)
    files = [info]
    if info.type == pafs.FileType.Directory:
        files = store.get_file_info(pafs.FileSelector(inside))
        files = [f for f in files if fnmatch.fnmatchcase(f.base_name, pattern if globbed else "*.tar")]
    return sorted((prefix + f.path + mark + query, f.size, str(f.mtime_ns)) for f in files if f.is_file)


def expand(path: str) -> list[tuple[str, int]]:
    """(path, size) of the tar files at a file, folder or glob; empty when missing."""
    return [(name, size) for name, size, _ in listed(path)]


def count_shards(paths: str | list[str]) -> int:
    """How many shards a scan of these paths numbers."""
    return sum(len(expand(p)) for p in ([paths] if isinstance(paths, str) else paths))


def split_name(name: str) -> tuple[str, str]:
    """A member's sample key and extension: cut at the first dot of the file name."""
    folder, _, base = name.rpartition("/")
    stem, _, ext = base.partition(".")
    return (f"{folder}/{stem}" if folder else stem), ext.lower()


@dataclass
class TarSplit(InputPartition):
    path: str
    shard_idx: int
    begin: int
    end: int


@dataclass
class TarSplits(InputPartition):
    """Neighbouring splits that one task reads, in order."""

    splits: list[TarSplit]


def packed(splits: list[TarSplit], pack_bytes: int, least_tasks: int) -> list[TarSplits]:
    """Splits in listing order, side by side in a task as long as they are small."""
    costs = [split.end - split.begin + OPEN_BYTES for split in splits]
    limit = min(pack_bytes, max(OPEN_BYTES, sum(costs) // max(least_tasks, 1)))
    tasks, held = [], 0
    for split, cost in zip(splits, costs):
        if not tasks or held + cost > limit:
            tasks.append(TarSplits([]))
            held = 0
        tasks[-1].splits.append(split)
        held += cost
    return tasks


def walk_tasks(spark: SparkSession, sizes: list[int]) -> int:
    """How many tasks should walk shards of these sizes, each as a whole."""
    cost = sum(sizes) + OPEN_BYTES * len(sizes)
    return min(len(sizes), max(-(-cost // PACK_BYTES), TASKS_PER_CORE * spark.sparkContext.defaultParallelism))


def _next_header(stream, begin: int, size: int) -> int | None:
    """Offset of the first block at or after ``begin`` that is a header by its checksum."""
    offset = -(-begin // BLOCK) * BLOCK
    while offset + BLOCK <= size:
        stream.seek(offset)
        window = stream.read(1 << 20)
        for at in range(0, len(window) - BLOCK + 1, BLOCK):
            try:
                tarfile.TarInfo.frombuf(window[at : at + BLOCK], "utf-8", "surrogateescape")
            except tarfile.HeaderError:
                continue
            return offset + at
        offset += max(len(window) // BLOCK, 1) * BLOCK
    return None


def _walk(stream, size: int) -> Iterator[tuple]:
    """(offset, archive, member, problem) of every member; after a problem the walk goes on at the next header.

    The end is a block of zeros or the end of the file; any other block that is no header is a
    problem. Errors of the store are not caught, so that Spark tries the task again.
    """
    start: int | None = 0
    while start is not None:
        at, why = start, None
        stream.seek(start)
        try:
            archive = tarfile.open(fileobj=stream, mode="r:")
            while (member := archive.next()) is not None:
                archive.members = []
                yield member.offset, archive, member, None
                at = archive.offset
            at = archive.offset
        except tarfile.TarError as problem:
            why = f"{type(problem).__name__}: {problem}"
        if why is None:
            stream.seek(at)
            block = stream.read(BLOCK)
            if at >= size or not block.strip(b"\0"):
                return
            why = f"no header at {at}"
        yield at, None, None, why
        start = _next_header(stream, at + BLOCK, size)


class _Samples:
    """The samples of one split, in file order.

    A split owns the samples that begin in it. Every split walks its shard's headers from the begin, without
    bodies, so all splits see the same samples as one scan does, whatever the bodies hold. A
    sample beside a corrupt header may lack members and is marked as bad.
    """

    def __init__(
        self,
        wanted: set[str] | None,
        sizes: bool,
        required: Iterable[str] = (),
        takes: Callable[[str], bool] | None = None,
    ):
        self.wanted = wanted
        self.sizes = sizes
        self.required = set(required)
        self.takes = takes

    def read(self, split: TarSplit) -> Iterator[dict]:
        store, inside = open_store(split.path)
        with store.open_input_file(inside) as stream:
            yield from self._groups(stream, split, stream.size())

    def _groups(self, stream, split: TarSplit, size: int) -> Iterator[dict]:
        row, problem_before = None, None
        for offset, archive, member, problem in _walk(stream, size):
            if problem:
                if row is None:
                    row = self._empty(split, offset, None)
                row["_error"] = row["_error"] or problem
                problem_before = problem
                continue
            if not member.isfile():
                continue
            key, ext = split_name(member.name)
            if row is not None and row["key"] != key:
                if split.begin <= row["pos"] * BLOCK:
                    yield from self._finished(row)
                row = None
            if row is None:
                if offset >= split.end:
                    return
                row = self._empty(split, offset, key)
                row["_error"] = problem_before
            problem_before = None
            row["members"].append(ext)
            row["places"].append((ext, member.offset_data, member.size))
            row["bytes"] += member.size
            if split.begin <= row["pos"] * BLOCK and (self.takes is None or self.takes(key)):
                if self.required:
                    row["_later"].append((archive, member, ext))
                else:
                    self._read(archive, member, ext, row)
        if row is not None and split.begin <= row["pos"] * BLOCK < split.end:
            yield from self._finished(row)

    def _read(self, archive, member, ext: str, row: dict) -> None:
        try:
            self._take(archive, member, ext, row)
        except tarfile.TarError as cut:
            row["_error"] = row["_error"] or f"{type(cut).__name__}: {cut}"

    def _finished(self, row: dict) -> Iterator[dict]:
        """The row with its bodies, unless it is not asked for."""
        later = row.pop("_later")
        if self.takes is not None and not self.takes(row["key"]):
            return
        if not self.required <= set(row["members"]):
            return
        for opened, member, ext in later:
            self._read(opened, member, ext, row)
        yield self._measured(row)

    def at(self, stream, offset: int) -> dict[str, bytes]:
        """The wanted members of the one sample that starts at ``offset``."""
        stream.seek(offset)
        archive = tarfile.open(fileobj=stream, mode="r:")
        row, first = {"fields": {}}, None
        for member in archive:
            key, ext = split_name(member.name)
            first = key if first is None else first
            if key != first:
                break
            archive.members = []
            if member.isfile():
                self._take(archive, member, ext, row)
        return row["fields"]

    def _empty(self, split: TarSplit, offset: int, key: str | None) -> dict:
        return {
            "shard": split.path,
            "shard_idx": split.shard_idx,
            "pos": offset // BLOCK,
            "key": key,
            "members": [],
            "places": [],
            "bytes": 0,
            "fields": {},
            "height": None,
            "width": None,
            "_error": None,
            "_images": {},
            "_later": [],
        }

    def _measured(self, row: dict) -> dict:
        """The size of the image that ``first_present`` takes, or its error."""
        images = row.pop("_images")
        for ext in IMAGE_EXTENSIONS:
            if ext in images:
                if images[ext] is None:
                    row["_error"] = row["_error"] or f"no image header in {row['key']}.{ext}"
                else:
                    row["height"], row["width"] = images[ext]
                break
        return row

    def _take(self, archive, member, ext: str, row: dict) -> None:
        keep = self.wanted is None or ext in self.wanted
        measure = self.sizes and ext in IMAGE_EXTENSIONS
        if not keep and not measure:
            return
        body = archive.extractfile(member)
        if keep:
            data = body.read()
            if len(data) < member.size:
                raise tarfile.ReadError(f"{member.name} is cut short")
            row["fields"][ext] = data
        else:
            data = body.read(HEADER_BYTES)
        if measure:
            size = header_size(data)
            if size is None and len(data) < member.size:
                body.seek(0)
                size = header_size(body.read())
            row["_images"][ext] = size


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p.strip() for p in options.get("path", "").split(",") if p.strip()]
        fields = options.get("fields", "*")
        self.wanted = None if fields.strip() == "*" else {f.strip() for f in fields.split(",") if f.strip()}
        self.sizes = options.get("sizes", "false").lower() == "true"
        self.split_bytes = max(int(options.get("splitbytes", SPLIT_BYTES)), BLOCK)
        self.ignore_missing = options.get("ignoremissing", "false").lower() == "true"
        self.required = {f.strip() for f in options.get("required", "").split(",") if f.strip()}

        self.shards = set(json.loads(options["shards"])) if "shards" in options else None
        self.prefixes = tuple(json.loads(options["keyprefixes"])) if "keyprefixes" in options else None
        self.pack_bytes = int(options["packbytes"]) if "packbytes" in options else None
        self.least_tasks = int(options.get("leasttasks", 1))

    def _takes(self, key: str | None) -> bool:
        return key is not None and key.startswith(self.prefixes)

    def partitions(self) -> list[TarSplit] | list[TarSplits]:
        splits = self._splits()
        return splits if self.pack_bytes is None else packed(splits, self.pack_bytes, self.least_tasks)

    def _splits(self) -> list[TarSplit]:
        files = []
        for path in self.paths:
            found = expand(path)
            if not found and not self.ignore_missing:
                raise FileNotFoundError(path)
            files.extend(found)
        return [
            TarSplit(path, i, begin, min(begin + self.split_bytes, size))
            for i, (path, size) in enumerate(files)
            if self.shards is None or i in self.shards
            for begin in range(0, max(size, 1), self.split_bytes)
        ]

    def read(self, partition: TarSplit | TarSplits | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark gives where there are no partitions
            return
        rows, held = [], 0
        samples = _Samples(self.wanted, self.sizes, self.required, self._takes if self.prefixes is not None else None)
        splits = partition.splits if isinstance(partition, TarSplits) else [partition]
        for row in (row for split in splits for row in samples.read(split)):
            row["fields"] = list(row["fields"].items())
            held += sum(len(data) for _, data in row["fields"])
            rows.append(row)
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


@dataclass
class WrittenShards(WriterCommitMessage):
    moves: list


class TarWriter(DataSourceArrowWriter):
    """One tar per shard number, written beside its final name and moved on commit."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.folder = options["path"].rstrip("/")
        self.names = schema.names
        self.overwrite = overwrite
        for needed in ("shard_no", "key"):
            if needed not in self.names:
                raise ValueError(f"a tar shard table needs the column {needed}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenShards:
        store, folder = open_store(self.folder)
        store.create_dir(folder, recursive=True)
        members = [n for n in self.names if n not in ("shard_no", "key")]
        moves, current, archive, stream = [], None, None, None
        seen = set()
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if row["shard_no"] != current:
                        if archive:
                            archive.close()
                            stream.close()
                        current = row["shard_no"]
                        if current in seen:
                            raise ValueError("rows must come sorted by shard_no")
                        seen.add(current)
                        hidden = f"{folder}/.{uuid.uuid4().hex}.tar.part"
                        moves.append((hidden, current))
                        stream = store.open_output_stream(hidden)
                        archive = tarfile.open(fileobj=stream, mode="w|")
                    self._add(archive, row, members)
            if archive:
                archive.close()
                stream.close()
        except BaseException:
            for hidden, _ in moves:
                if store.get_file_info(hidden).is_file:
                    store.delete_file(hidden)
            raise
        return WrittenShards(moves)

    def _add(self, archive, row: dict, members: list[str]) -> None:
        import io

        for ext in members:
            data = row[ext]
            if data is None:
                continue
            data = data.encode() if isinstance(data, str) else data
            # A column name cannot hold a dot easily, so two-part extensions use "__".
            info = tarfile.TarInfo(f"{row['key']}.{ext.replace('__', '.')}")
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))

    def commit(self, messages: list) -> None:
        """Give shards their names: in append mode after the highest number there, else in place of the old ones.

        Old shards go last, so a failure never leaves less than one whole set.
        """
        store, folder = open_store(self.folder)
        moves = [move for message in messages if message for move in message.moves]
        if len({number for _, number in moves}) != len(moves):
            self.abort(messages)
            raise ValueError("a shard number occurs in two tasks: repartition by shard_no first")
        old = {}
        for info in store.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            number = re.fullmatch(r"shard-(\d+)\.tar", info.path.rsplit("/", 1)[-1])
            if info.is_file and number:
                old[int(number[1])] = info.path
        first = 0 if self.overwrite else max(old, default=-1) + 1
        names = {f"{folder}/shard-{first + number:06d}.tar": hidden for hidden, number in moves}
        with ThreadPoolExecutor(MOVES_AT_ONCE) as pool:
            list(pool.map(lambda name: store.move(names[name], name), names))
        if self.overwrite:
            for path in set(old.values()) - set(names):
                store.delete_file(path)

    def abort(self, messages: list) -> None:
        store, _ = open_store(self.folder)
        for message in messages:
            for hidden, _ in message.moves if message else []:
                if store.get_file_info(hidden).is_file:
                    store.delete_file(hidden)


class TarShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarshards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TarReader:
        return TarReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> TarWriter:
        return TarWriter(dict(self.options), schema, overwrite)


def tar_scan(
    spark: SparkSession,
    paths: str | list[str],
    fields: list[str] | None = None,
    sizes: bool = False,
    split_bytes: int = SPLIT_BYTES,
    ignore_missing: bool = False,
    bad_samples: str = "drop",
    required: list[str] | None = None,
    shards: Iterable[int] | None = None,
    key_prefixes: list[str] | None = None,
) -> DataFrame:
    """The samples of tar shards, one row each.

    Of ``shards`` only these numbers are opened (``shard_idx`` stays the place in the whole listing);
    samples without all ``required`` members, or whose key begins with none of ``key_prefixes``, are left
    out before their bodies are read. ``pos`` is the sample's place in its shard, in 512-byte units. ``fields`` limits
    the members that are read. ``bad_samples`` is ``drop``, ``keep`` (see ``_error``)
    or ``only``, for a quarantine table.
    """
    spark.dataSource.register(TarShards)
    reader = (
        spark.read.format("tarshards")
        .option("path", ",".join([paths] if isinstance(paths, str) else paths))
        .option("fields", "*" if fields is None else ",".join(fields))
        .option("sizes", str(sizes).lower())
        .option("splitBytes", split_bytes)
        .option("ignoreMissing", str(ignore_missing).lower())
        .option("required", ",".join(required or []))
        .option("packBytes", PACK_BYTES)
        .option("leastTasks", TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    )
    if shards is not None:
        reader = reader.option("shards", json.dumps(sorted(shards)))
    if key_prefixes is not None:
        reader = reader.option("keyPrefixes", json.dumps(key_prefixes))
    rows = reader.load()
    if bad_samples == "drop":
        return rows.filter("_error IS NULL")
    return rows.filter("_error IS NOT NULL") if bad_samples == "only" else rows


def fetch_tasks(index: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """How many tasks should fetch the members of these rows, by the sum of ``bytes``.

    The rows themselves are narrow, so left to adaptive execution a few tasks would
    have to fetch everything.
    """
    total = index.agg(F.sum("bytes")).first()[0] or 0
    return max(-(-total // task_bytes), index.sparkSession.sparkContext.defaultParallelism)


def by_shard(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows of a new shard side by side, in order; a task holds whole shards."""
    spread = df.repartition(tasks, "shard_no") if tasks else df.repartition("shard_no")
    return spread.sortWithinPartitions("shard_no", "shard_pos")


def with_members(df: DataFrame, fields: list[str]) -> DataFrame:
    """Add ``fields``, the wanted members of each row's sample, read at (``shard``, ``pos``).

    Number, batch or join the rows of a scan without bodies first and fetch the bytes
    last: then images go from storage to the task that uses them and no shuffle
    carries them. Rows in shard order make the reads sequential.
    """
    wanted = set(fields)
    added = pa.field("fields", pa.map_(pa.string(), pa.binary()))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened, stream = _Samples(wanted, False), None, None
        for batch in batches:
            schema = batch.schema.append(added)
            paths, places = batch.column("shard").to_pylist(), batch.column("pos").to_pylist()
            begin, members, held = 0, [], 0
            for i, (path, pos) in enumerate(zip(paths, places)):
                if path != opened:
                    if stream:
                        stream.close()
                    store, inside = open_store(path)
                    opened, stream = path, store.open_input_file(inside)
                members.append(list(reader.at(stream, pos * BLOCK).items()))
                held += sum(len(data) for _, data in members[-1])
                if held >= BATCH_BYTES or i + 1 == len(paths):
                    part = batch.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(members, added.type)], schema=schema)
                    begin, members, held = i + 1, [], 0
        if stream:
            stream.close()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(fetch, f"{schema}, fields map<string, binary>")


def write_shards(df: DataFrame, path: str, columns: list[str], key: str = "shard_key", mode: str = "append") -> None:
    """Write numbered samples as ``shard-%06d.tar``, one member per column.

    ``df`` has ``shard_no``, ``shard_pos`` and ``shard_key``, as ``shard_numbering``
    adds them, and its rows are arranged by ``by_shard``. ``key`` names the samples. A
    column's name is its extension; ``latent__bin`` is ``latent.bin``.
    """
    df.sparkSession.dataSource.register(TarShards)
    chosen = df.select("shard_no", F.col(key).alias("key"), *columns)
    chosen.write.format("tarshards").option("path", path).mode(mode).save()
