"""A table of the members of tar shards, from which later reads follow.

``indexed_samples`` keeps a Parquet table beside the shards: one row per sample with the place (offset and size) of each
of its members. A shard is walked once, by one task, when it is new or its size or version has changed; all later reads
know their bytes. They are planned like any table: filters on ``key`` and ``shard`` reach the Parquet scan, tasks are cut by the bytes
they fetch, inside shards too, and each reads the wanted bodies only and no header.

A refresh appends; each shard's rows are written by one task into one file, and end with a marker row, so a failed or a
concurrent refresh leaves shards that are there in whole or not at all, and of several the newest counts.
``compact_index`` leaves out what is no longer listed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framekiln.sources import tar

INDEX = (
    "shard string, shard_bytes bigint, version string, built string, pos bigint, key string, "
    "places array<struct<ext: string, offset: bigint, size: bigint>>, bytes bigint, height int, width int, _error string"
)
_PLACES = pa.list_(pa.struct([("ext", pa.string()), ("offset", pa.int64()), ("size", pa.int64())]))
_ARROW = pa.schema(
    [
        ("shard", pa.string()),
        ("shard_bytes", pa.int64()),
        ("version", pa.string()),
        ("built", pa.string()),
        ("pos", pa.int64()),
        ("key", pa.string()),
        ("places", _PLACES),
        ("bytes", pa.int64()),
        ("height", pa.int32()),
        ("width", pa.int32()),
        ("_error", pa.string()),
    ]
)
# A marker row has this position; samples count from 0.
MARKER = -1
# Bodies closer than this are read at once.
GAP = 1 << 15


def _listing(spark: SparkSession, paths: str | list[str], ignore_missing: bool) -> DataFrame:
    found = []
    for path in [paths] if isinstance(paths, str) else paths:
        files = tar.listed(path)
        if not files and not ignore_missing:
            raise FileNotFoundError(path)
        found += files
    rows = [(i, *file) for i, file in enumerate(found)]
    return spark.createDataFrame(rows, "shard_idx int, shard string, shard_bytes bigint, version string")


def _known(spark: SparkSession, index_path: str) -> DataFrame:
    try:
        return spark.read.schema(INDEX).parquet(index_path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INDEX)


def _newest(known: DataFrame) -> DataFrame:
    """(shard, shard_bytes, version, built) of the shards that are indexed in whole."""
    return known.filter(F.col("pos") == MARKER).groupBy("shard", "shard_bytes", "version").agg(F.max("built").alias("built"))


def _walk(sizes: bool, built: str):
    """Index rows of each listed shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = tar._Samples(set(), sizes)
        for batch in batches:
            for shard in batch.to_pylist():
                stamp = {"shard_bytes": shard["shard_bytes"], "version": shard["version"], "built": built}
                rows = []
                for row in samples.read(tar.TarSplit(shard["shard"], 0, 0, max(shard["shard_bytes"], 1))):
                    row["places"] = [dict(zip(("ext", "offset", "size"), place)) for place in row["places"]]
                    rows.append({**row, **stamp})
                    if len(rows) >= tar.BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows = []
                rows.append({"shard": shard["shard"], **stamp, "pos": MARKER, "places": [], "bytes": 0})
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return run


def refresh_index(
    spark: SparkSession, paths: str | list[str], index_path: str, sizes: bool = True, ignore_missing: bool = False
) -> int:
    """Index the shards that are new or have changed; returns how many. ``sizes`` reads image headers too."""
    listed = _listing(spark, paths, ignore_missing)
    missing = listed.join(_newest(_known(spark, index_path)), ["shard", "shard_bytes", "version"], "left_anti")
    missing = missing.dropDuplicates(["shard"]).select("shard", "shard_bytes", "version").collect()  # names, as the listing itself
    if missing:
        # The build's name sorts by time; a shard is walked by one task, and small shards share tasks.
        built = f"{spark.sql('SELECT unix_micros(current_timestamp())').first()[0]:020d}-{uuid.uuid4().hex}"
        todo = spark.createDataFrame(missing, "shard string, shard_bytes bigint, version string")
        todo = todo.repartition(tar.walk_tasks(spark, [shard["shard_bytes"] for shard in missing]))
        todo.mapInArrow(_walk(sizes, built), INDEX).write.mode("append").parquet(index_path)
    return len(missing)


def indexed_samples(
    spark: SparkSession,
    paths: str | list[str],
    index_path: str,
    sizes: bool = True,
    ignore_missing: bool = False,
    bad_samples: str = "drop",
) -> DataFrame:
    """The samples of shards by their index, brought up to date first.

    Columns as of ``tar_scan`` without ``fields``, and ``places``; add bodies by ``with_placed_members``.
    """
    refresh_index(spark, paths, index_path, sizes, ignore_missing)
    known = _known(spark, index_path)
    listed = _listing(spark, paths, ignore_missing)
    stamp = ["shard", "shard_bytes", "version"]
    chosen = listed.join(_newest(known), stamp).select("shard_idx", "shard", "built")
    rows = known.filter(F.col("pos") > MARKER).join(chosen, ["shard", "built"])
    members = F.transform("places", lambda p: p["ext"])
    rows = rows.select("shard", "shard_idx", "pos", "key", members.alias("members"), "places", "bytes", "height", "width", "_error")
    if bad_samples == "drop":
        return rows.filter("_error IS NULL")
    return rows.filter("_error IS NOT NULL") if bad_samples == "only" else rows


def _runs(places: list[dict], wanted: set[str]) -> list[list[dict]]:
    """The wanted places in order, those close to each other together."""
    runs: list[list[dict]] = []
    for place in sorted((p for p in places if p["ext"] in wanted), key=lambda p: p["offset"]):
        if runs and place["offset"] - (runs[-1][-1]["offset"] + runs[-1][-1]["size"]) <= GAP:
            runs[-1].append(place)
        else:
            runs.append([place])
    return runs


def _bodies(stream, places: list[dict], wanted: set[str]) -> tuple[dict[str, bytes], str | None]:
    """The wanted bodies of a sample, and what is wrong if one is cut short. A repeated name counts once, the last."""
    found, problem = {}, None
    for run in _runs(places, wanted):
        begin, end = run[0]["offset"], run[-1]["offset"] + run[-1]["size"]
        stream.seek(begin)
        data = stream.read(end - begin)
        for place in run:
            body = data[place["offset"] - begin : place["offset"] - begin + place["size"]]
            if len(body) < place["size"]:
                problem = problem or f"{place['ext']} is cut short"
            else:
                found[place["ext"]] = body
    return found, problem


def with_placed_members(df: DataFrame, fields: list[str], task_bytes: int = tar.TASK_BYTES) -> DataFrame:
    """Add ``fields``, the wanted members by extension, read at their places; ``_error`` tells of bodies cut short.

    Tasks get about ``task_bytes`` of neighbouring samples each, so a large shard is read by several.
    """
    wanted = set(fields)
    added = pa.field("fields", pa.map_(pa.string(), pa.binary()))
    piece = F.floor(F.col("pos") * F.lit(tar.BLOCK) / F.lit(task_bytes))
    spread = df.repartition(tar.fetch_tasks(df, task_bytes), "shard", piece).sortWithinPartitions("shard", "pos")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, stream = None, None
        for batch in batches:
            at = batch.schema.get_field_index("_error")
            rows = zip(batch.column("shard").to_pylist(), batch.column("places").to_pylist(), batch.column("_error").to_pylist())
            begin, bodies, errors, held = 0, [], [], 0
            for i, (path, places, error) in enumerate(rows):
                if path != opened:
                    if stream:
                        stream.close()
                    store, inside = tar.open_store(path)
                    opened, stream = path, store.open_input_file(inside)
                found, problem = _bodies(stream, places, wanted)
                bodies.append(list(found.items()))
                errors.append(error or problem)
                held += sum(map(len, found.values()))
                if held >= tar.BATCH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(begin, i + 1 - begin).set_column(at, batch.schema.field(at), pa.array(errors, pa.string()))
                    columns = [*part.columns, pa.array(bodies, added.type)]
                    yield pa.RecordBatch.from_arrays(columns, schema=batch.schema.append(added))
                    begin, bodies, errors, held = i + 1, [], [], 0
        if stream:
            stream.close()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return spread.mapInArrow(fetch, f"{schema}, fields map<string, binary>")


def compact_index(spark: SparkSession, paths: str | list[str], index_path: str, out: str) -> None:
    """A copy of the index at ``out`` with the newest rows of the listed shards only."""
    listed = _listing(spark, paths, True)
    known = _known(spark, index_path)
    chosen = _newest(known).join(listed.dropDuplicates(["shard"]), ["shard", "shard_bytes", "version"], "left_semi")
    kept = known.join(chosen.select("shard", "built"), ["shard", "built"], "left_semi").select(*known.columns)
    kept.repartition("shard").sortWithinPartitions("shard", "pos").write.parquet(out)
