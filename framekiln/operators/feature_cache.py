"""A feature cache of committed parts.

The cache is a folder of Parquet parts and of numbered snapshots. A snapshot is a small file that lists the parts that count; it
appears in one move, after its parts are written. So a reader takes the newest snapshot and sees a refresh in whole or not at all,
also while the next one runs, and a failed refresh leaves parts that no snapshot lists. ``compact`` replaces the parts by
one, sorted by key; old parts stay for readers that still hold an older snapshot, until ``vacuum``.

One writer at a time: a snapshot whose number exists already is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framekiln.operators.features import cache_hits, cache_misses, valid_features
from framekiln.sources.tar import open_store


class FeatureCache:
    """Features by ``keys`` at ``path``; ``schema`` has the keys, the features and, for rows that failed, ``_error``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.empty = spark.createDataFrame([], schema)

    def snapshot(self) -> tuple[int, list[str]]:
        """Number and parts of the newest snapshot; (-1, []) for a new cache."""
        store, folder = open_store(self.path)
        found = store.get_file_info(pafs.FileSelector(f"{folder}/snapshots", allow_not_found=True))
        names = sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(".json") and not f.base_name.startswith("."))
        if not names:
            return -1, []
        with store.open_input_file(f"{folder}/snapshots/{names[-1]}") as file:
            return int(names[-1][: -len(".json")]), json.loads(file.read())

    def read(self, snapshot: tuple[int, list[str]] | None = None) -> DataFrame:
        """All rows of a snapshot, by default of the newest."""
        _, parts = snapshot or self.snapshot()
        if not parts:
            return self.empty
        return self.spark.read.schema(self.empty.schema).parquet(*[f"{self.path}/parts/{p}" for p in parts])

    def _commit(self, number: int, parts: list[str]) -> None:
        store, folder = open_store(self.path)
        store.create_dir(f"{folder}/snapshots", recursive=True)
        name = f"{folder}/snapshots/{number:012d}.json"
        if store.get_file_info(name).is_file:
            raise RuntimeError(f"another writer has made snapshot {number} of {self.path}")
        hidden = f"{folder}/snapshots/.{uuid.uuid4().hex}"
        with store.open_output_stream(hidden) as out:
            out.write(json.dumps(parts).encode())
        store.move(hidden, name)

    def misses(self, samples: DataFrame) -> DataFrame:
        """The samples without usable features, each key once."""
        return cache_misses(self.read(), samples, self.keys).dropDuplicates(self.keys)

    def refresh(self, samples: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> int:
        """Encode the samples that the cache lacks; returns how many. Nothing is written if there are none."""
        number, parts = before = self.snapshot()
        missing = cache_misses(self.read(before), samples, self.keys).dropDuplicates(self.keys)
        count = missing.count()
        if count:
            part = uuid.uuid4().hex
            encode(missing).select(*self.empty.columns).write.parquet(f"{self.path}/parts/{part}")
            self._commit(number + 1, [*parts, part])
        return count

    def features(self, samples: DataFrame) -> DataFrame:
        """The usable features of the samples, each key once."""
        return cache_hits(self.read(), samples, self.keys).dropDuplicates(self.keys)

    def compact(self) -> None:
        """One part of usable rows, each key once, in place of all."""
        number, parts = before = self.snapshot()
        if parts:
            part = uuid.uuid4().hex
            kept = valid_features(self.read(before)).dropDuplicates(self.keys)
            kept.sortWithinPartitions(*self.keys).write.parquet(f"{self.path}/parts/{part}")
            self._commit(number + 1, [part])

    def vacuum(self) -> int:
        """Delete parts that the newest snapshot doesn't list; returns how many. No reader or writer may be at work."""
        store, folder = open_store(self.path)
        _, parts = self.snapshot()
        found = store.get_file_info(pafs.FileSelector(f"{folder}/parts", allow_not_found=True))
        old = [f.path for f in found if f.type == pafs.FileType.Directory and f.base_name not in parts]
        for path in old:
            store.delete_dir(path)
        return len(old)


def keyed(index: DataFrame) -> DataFrame:
    """``sample``: a key of a sample by its shard and place, and of the size that it is brought to."""
    return index.withColumn("sample", F.concat_ws("|", "shard", "pos", "target_height", "target_width"))
