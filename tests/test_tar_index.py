"""The member index, ranges of bytes, and scans that leave out shards and samples."""

import io
import tarfile
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from framekiln.plans import dataset
from framekiln.sources import ranges, tar, tar_index
from workload.media import png_bytes

PNG = png_bytes(np.zeros((2, 3, 3), np.uint8))


def write_tar(path, members, mtime=0):
    with tarfile.open(path, "w") as archive:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size, info.mtime = len(data), mtime
            archive.addfile(info, io.BytesIO(data))


def samples(count, size=700):
    return [m for i in range(count) for m in ((f"{i:02d}.txt", b"%02d" % i * size), (f"{i:02d}.png", PNG))]


COLUMNS = ["shard_idx", "pos", "key", "members", "bytes", "height", "width", "_error"]


def rows_of(frame, *more):
    return [tuple(r) for r in frame.select(*COLUMNS, *more).orderBy("shard_idx", "pos").collect()]


@pytest.fixture()
def folder(tmp_path):
    """Shards that are whole, damaged in a header, cut off, empty, and with long names."""
    home = tmp_path / "shards"
    home.mkdir()
    write_tar(home / "a.tar", samples(9))
    write_tar(home / "b.tar", samples(12))
    with tarfile.open(home / "b.tar") as archive:
        at = archive.getmembers()[7].offset
    data = bytearray((home / "b.tar").read_bytes())
    data[at + 3] ^= 0xFF
    (home / "b.tar").write_bytes(bytes(data))
    write_tar(home / "c.tar", samples(10))
    (home / "c.tar").write_bytes((home / "c.tar").read_bytes()[: 512 * 12 + 700])
    write_tar(home / "d.tar", [])
    write_tar(home / "e.tar", [(f"{'long' * 40}{i}.latent.bin", b"x" * i) for i in range(5)] + [("z.png", b"junk")], mtime=1.5)
    return home


def test_index_equals_the_scan(spark, folder, tmp_path):
    index = str(tmp_path / "index")
    whole = tar.tar_scan(spark, str(folder), fields=[], sizes=True, bad_samples="keep")
    indexed = tar_index.indexed_samples(spark, str(folder), index, bad_samples="keep")
    assert rows_of(indexed) == rows_of(whole)
    for kind in ("drop", "only"):
        same = tar_index.indexed_samples(spark, str(folder), index, bad_samples=kind)
        assert rows_of(same) == rows_of(tar.tar_scan(spark, str(folder), fields=[], sizes=True, bad_samples=kind))


@pytest.mark.parametrize("task_bytes", [512, 5000, 1 << 30])
def test_bodies_by_place(spark, folder, tmp_path, task_bytes):
    scanned = tar.tar_scan(spark, str(folder), fields=["txt", "latent.bin"])
    found = tar_index.indexed_samples(spark, str(folder), str(tmp_path / "index"), sizes=False)
    found = tar_index.with_placed_members(found, ["txt", "latent.bin"], task_bytes)
    assert {(r.shard_idx, r.key): r.fields for r in found.collect()} == {(r.shard_idx, r.key): r.fields for r in scanned.collect()}


def test_no_header_is_read_again(spark, folder, tmp_path):
    """With the index built, headers may be lost: bodies are read at their places."""
    index = str(tmp_path / "index")
    tar_index.refresh_index(spark, str(folder), index)
    rows = tar_index.indexed_samples(spark, str(folder / "a.tar"), index).select("shard", "pos", "places", "bytes", "_error")
    kept = spark.createDataFrame(rows.collect(), rows.schema)
    data = bytearray((folder / "a.tar").read_bytes())
    with tarfile.open(folder / "a.tar") as archive:
        for member in archive:
            data[member.offset : member.offset_data] = b"\xff" * (member.offset_data - member.offset)
    (folder / "a.tar").write_bytes(bytes(data))
    got = tar_index.with_placed_members(kept, ["txt"]).collect()
    assert sorted(bytes(r.fields["txt"][:2]) for r in got) == [b"%02d" % i for i in range(9)]


def test_refresh_walks_new_and_changed_shards_only(spark, folder, tmp_path):
    index = str(tmp_path / "index")
    assert tar_index.refresh_index(spark, str(folder), index) == 5
    assert tar_index.refresh_index(spark, str(folder), index) == 0
    write_tar(folder / "f.tar", samples(3))
    write_tar(folder / "a.tar", samples(4))
    assert tar_index.refresh_index(spark, str(folder), index) == 2
    got = tar_index.indexed_samples(spark, str(folder), index)
    assert got.filter("shard LIKE '%/a.tar'").count() == 4 and got.filter("shard LIKE '%/f.tar'").count() == 3
    (folder / "f.tar").unlink()
    assert tar_index.indexed_samples(spark, str(folder), index).filter("shard LIKE '%/f.tar'").count() == 0


def test_two_builds_of_one_shard_count_once(spark, folder, tmp_path):
    index, other = str(tmp_path / "index"), str(tmp_path / "other")
    tar_index.refresh_index(spark, str(folder), index)
    tar_index.refresh_index(spark, str(folder), other)
    spark.read.parquet(other).write.mode("append").parquet(index)
    # Rows of a build without its marker are those of a failed task.
    broken = spark.read.parquet(other).filter("pos >= 0").withColumn("built", F.lit("9" * 60))
    broken.write.mode("append").parquet(index)
    whole = tar.tar_scan(spark, str(folder), fields=[], sizes=True, bad_samples="keep")
    assert rows_of(tar_index.indexed_samples(spark, str(folder), index, bad_samples="keep")) == rows_of(whole)
    small = str(tmp_path / "small")
    tar_index.compact_index(spark, str(folder), index, small)
    assert spark.read.parquet(small).count() == spark.read.parquet(other).count()
    assert rows_of(tar_index.indexed_samples(spark, str(folder), small, bad_samples="keep")) == rows_of(whole)


def test_cut_after_indexing_is_an_error_of_the_sample(spark, tmp_path):
    home = tmp_path / "s"
    home.mkdir()
    write_tar(home / "a.tar", samples(5))
    rows = tar_index.indexed_samples(spark, str(home), str(tmp_path / "index"))
    kept = spark.createDataFrame(rows.collect(), rows.schema)
    (home / "a.tar").write_bytes((home / "a.tar").read_bytes()[:6000])
    got = {r.key: r._error for r in tar_index.with_placed_members(kept, ["txt"]).collect()}
    assert got["00"] is None and got["04"] == "txt is cut short"


def test_filters_reach_the_index(spark, folder, tmp_path):
    rows = tar_index.indexed_samples(spark, str(folder), str(tmp_path / "index")).filter("key = '03'")
    plan = rows._jdf.queryExecution().toString()
    assert "EqualTo(key,03)" in plan and {r.key for r in rows.collect()} == {"03"}


def test_pruned_scan_opens_no_other_shard(spark, folder):
    """Shards that are left out may be unreadable."""
    before = {r.key for r in tar.tar_scan(spark, str(folder), fields=["txt"], shards=[0]).collect()}
    reader = tar.TarReader({"path": str(folder), "shards": "[0, 2]", "splitbytes": "4096"})
    assert {p.shard_idx for p in reader.partitions()} == {0, 2}
    for name in "bcde":
        (folder / f"{name}.tar").chmod(0)
        (folder / f"{name}.tar").unlink()
        (folder / f"{name}.tar").symlink_to(folder / f"{name}.tar.gone")
    got = tar.tar_scan(spark, str(folder / "a.tar"), fields=["txt"], shards=[0])
    assert {r.key for r in got.collect()} == before == {f"{i:02d}" for i in range(9)}
    assert tar.tar_scan(spark, str(folder / "a.tar"), shards=[]).count() == 0


def test_bodies_of_other_samples_are_not_read(tmp_path, monkeypatch):
    write_tar(tmp_path / "s.tar", [*samples(30), ("x.txt", b"only text")])
    taken = []
    take = tar._Samples._take
    monkeypatch.setattr(tar._Samples, "_take", lambda self, archive, member, ext, row: (taken.append(member.name), take(self, archive, member, ext, row)))
    options = {"path": str(tmp_path), "fields": "txt", "keyprefixes": '["1"]', "required": "txt,png"}
    reader = tar.TarReader(options)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["key"] for r in rows] == [f"1{i}" for i in range(10)] and all(dict(r["fields"])["txt"] for r in rows)
    assert {n[:2] for n in taken} == {r["key"] for r in rows}
    taken.clear()
    reader = tar.TarReader({"path": str(tmp_path), "required": "txt,png"})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 30 and "x.txt" not in taken


def test_reshard_by_index(spark, tmp_path):
    home = tmp_path / "in"
    home.mkdir()
    for i in range(3):
        write_tar(home / f"shard-{i:06d}.tar", samples(7))
    for name, index in (("plain", None), ("indexed", str(tmp_path / "index"))):
        dataset.reshard(spark, str(home), str(tmp_path / name), 5, members=("png", "txt"), index_path=index)
    read = lambda name: [tuple(r) for r in tar.tar_scan(spark, str(tmp_path / name)).select("shard_idx", "key", "fields").orderBy("shard_idx", "key").collect()]
    assert read("plain") == read("indexed") and len(read("plain")) == 21


class Answer(io.BytesIO):
    def __init__(self, data, status, headers):
        super().__init__(data)
        self.status, self.headers = status, headers


class Server:
    """Stands for urlopen: ranges of one file, with failures before some answers."""

    def __init__(self, data, failures=(), ranges=True):
        self.data, self.failures, self.ranges, self.asked = data, list(failures), ranges, []

    def __call__(self, request, timeout):
        if self.failures:
            raise self.failures.pop(0)
        begin, end = map(int, request.get_header("Range")[len("bytes=") :].split("-"))
        self.asked.append((begin, end + 1))
        if not self.ranges:
            return Answer(self.data, 200, {})
        headers = {"Content-Range": f"bytes {begin}-{end}/{len(self.data)}", "ETag": '"v1"'}
        return Answer(self.data[begin : end + 1], 206, headers)


URL = "https://images.test/a/shard-000000.tar?signature=x%2Fy"


def http_error(code):
    return urllib.error.HTTPError(URL, code, "no", {}, None)


def test_shard_behind_a_url(tmp_path, monkeypatch):
    write_tar(tmp_path / "s.tar", samples(40, 3000))
    server = Server((tmp_path / "s.tar").read_bytes(), [http_error(503), urllib.error.URLError("reset")])
    monkeypatch.setattr(ranges, "WAIT", 0.001)
    monkeypatch.setattr(tar, "open_store", lambda path: (ranges.HttpStore(server), path))
    assert tar.listed(URL) == [(URL, len(server.data), '"v1"')]
    reader = tar.TarReader({"path": URL, "fields": "txt", "splitbytes": "50000"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["key"] for r in rows] == [f"{i:02d}" for i in range(40)] and all(r["shard"] == URL for r in rows)
    assert [dict(r["fields"])["txt"] for r in rows] == [b"%02d" % i * 3000 for i in range(40)]
    places = list(tar._Samples(set(), False).read(tar.TarSplit(URL, 0, 0, len(server.data))))[7]["places"]
    server.asked.clear()
    store, inside = tar.open_store(URL)
    bodies, problem = tar_index._bodies(store.open_input_file(inside), [dict(zip(("ext", "offset", "size"), p)) for p in places], {"txt"})
    assert bodies == {"txt": b"07" * 3000} and problem is None
    assert len(server.asked) == 2  # its size, and the body


def test_servers_that_fail(monkeypatch):
    monkeypatch.setattr(ranges, "WAIT", 0.001)
    with pytest.raises(OSError, match="no byte ranges"):
        ranges.HttpStore(Server(b"x" * 100, ranges=False)).stat(URL)
    with pytest.raises(FileNotFoundError):
        ranges.HttpStore(Server(b"", [http_error(404)])).stat(URL)
    with pytest.raises(urllib.error.HTTPError):
        ranges.HttpStore(Server(b"", [http_error(403)])).stat(URL)
    with pytest.raises(urllib.error.HTTPError):
        ranges.HttpStore(Server(b"", [http_error(500)] * ranges.TRIES)).stat(URL)
    short = ranges.RangeFile(lambda begin, end: b"x", 100)
    with pytest.raises(OSError, match="1 bytes instead of 100"):
        short.read()


def test_range_file_reads_like_a_file():
    data = bytes(range(256)) * 40
    asked = []
    file = ranges.RangeFile(lambda a, b: (asked.append((a, b)), data[a:b])[1], len(data), ahead=512)
    plain = io.BytesIO(data)
    for at, size in [(0, 10), (10, 100), (300, 300), (5, 0), (9000, 5000), (10239, 5), (20000, 4), (100, -1)]:
        file.seek(at), plain.seek(at)
        assert file.read(size) == plain.read(size)
        assert file.tell() == max(plain.tell(), at)
    assert asked[0] == (0, 512)  # the next read came from it
    file.seek(-6, io.SEEK_END)
    assert file.read(3) == data[-6:-3] and file.seek(2, io.SEEK_CUR) == len(data) - 1
