"""Micro-batches of many small shards follow their bytes, and their reading is spread over tasks."""

import io
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from framekiln.sources import tar
from framekiln.streaming import arrival, batcher, committed, sinks
from workload.streams import landed_in_order

SHARDS = 40


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("arrived")
    for n in reversed(range(SHARDS)):
        with tarfile.open(path / f"shard-{n:06d}.tar", "w") as archive:
            for i in range(3):
                info = tarfile.TarInfo(f"{i:03d}.txt")
                info.size = 6
                archive.addfile(info, io.BytesIO(b"%06d" % (3 * n + i)))
    return str(path)


@pytest.mark.parametrize("rule, most", [({}, 1), ({"max_bytes": 200_000}, 3), ({"max_files": 10}, 4)])
def test_micro_batches_follow_bytes(spark, folder, tmp_path, rule, most):
    stream = arrival.arriving_shards(spark, folder, **rule).select("shard_idx", "key", F.col("fields")["txt"].cast("string").alias("txt"))
    sinks.drain(stream, f"{tmp_path}/table", f"{tmp_path}/mark")
    batches = [name for name in os.listdir(f"{tmp_path}/mark/commits") if name.isdigit()]
    assert len(batches) == most
    rows = spark.read.parquet(f"{tmp_path}/table").orderBy("txt").collect()
    assert [(r.shard_idx, r.key, r.txt) for r in rows] == [(n // 3, f"{n % 3:03d}", f"{n:06d}") for n in range(3 * SHARDS)]
    files = [name for name in os.listdir(f"{tmp_path}/table") if name.endswith(".parquet")]
    assert len(files) > most  # more than one task reads a micro-batch


def test_shards_of_several_micro_batches_keep_their_order(spark, folder, tmp_path):
    """The newest number was written first; landed in order, samples of all micro-batches go on in order."""
    narrow = arrival.arriving_shards(spark, landed_in_order(folder), fields=[], max_bytes=100_000)
    narrow = narrow.select(F.lit(0).alias("rank"), F.lit("all").alias("bucket"), "shard_idx", "pos", "shard")
    committed.stream_to_shards(batcher.stream_bucket_batches(narrow, 7), f"{tmp_path}/out", f"{tmp_path}/mark", ["txt"])
    assert len(committed.committed(f"{tmp_path}/out")) > 2
    rows = tar.tar_scan(spark, f"{tmp_path}/out/rank-00000").collect()
    whole = 3 * SHARDS // 7 * 7
    assert sorted((r.shard_idx, r.key, int(r.fields["txt"])) for r in rows) == [(i // 7, f"{i % 7:06d}", i) for i in range(whole)]
