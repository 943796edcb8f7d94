"""Scans of many small shards take few tasks and give the same samples."""

import io
import tarfile

import pytest

from framekiln.sources import tar, tar_index

SHARDS = 300


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("many")
    for n in range(SHARDS):
        with tarfile.open(path / f"shard-{n:06d}.tar", "w") as archive:
            for i in range(n % 3 + 1):
                data = f"{n}-{i}".encode()
                info = tarfile.TarInfo(f"{i:03d}.txt")
                info.size = len(data)
                archive.addfile(info, io.BytesIO(data))
    return str(path)


def test_small_shards_share_tasks(spark, folder):
    scan = tar.tar_scan(spark, folder)
    tasks = scan.rdd.getNumPartitions()
    parallel = spark.sparkContext.defaultParallelism
    assert parallel <= tasks <= 2 * tar.TASKS_PER_CORE * parallel < SHARDS
    rows = [(r.shard_idx, r.key, bytes(r.fields["txt"]).decode()) for r in scan.collect()]
    assert rows == [(n, f"{i:03d}", f"{n}-{i}") for n in range(SHARDS) for i in range(n % 3 + 1)]


def test_large_splits_stay_alone():
    sizes = [10, 100 << 20, 20, 30, 63 << 20, 40]
    splits = [tar.TarSplit(f"s{i}", i, 0, size) for i, size in enumerate(sizes)]
    tasks = tar.packed(splits, tar.PACK_BYTES, 1)
    assert [[s.shard_idx for s in t.splits] for t in tasks] == [[0], [1], [2, 3], [4], [5]]
    assert [s for t in tar.packed(splits, tar.PACK_BYTES, 100) for s in t.splits] == splits
    assert tar.packed([], tar.PACK_BYTES, 8) == []


def test_index_of_small_shards_shares_tasks(spark, folder, tmp_path):
    assert tar_index.refresh_index(spark, folder, str(tmp_path / "index")) == SHARDS
    files = [p for p in (tmp_path / "index").iterdir() if p.suffix == ".parquet"]
    assert 0 < len(files) <= tar.TASKS_PER_CORE * spark.sparkContext.defaultParallelism < SHARDS
    assert tar_index.indexed_samples(spark, folder, str(tmp_path / "index")).count() == 2 * SHARDS
