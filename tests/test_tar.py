import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from framekiln.functions import captions, fields
from framekiln.operators.buckets import Bins
from framekiln.plans import training
from framekiln.sources import tar
from workload.media import png_bytes

PNG = png_bytes(np.zeros((2, 3, 3), np.uint8))


def write_tar(path, members, mtime=0):
    with tarfile.open(path, "w") as archive:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size, info.mtime = len(data), mtime
            archive.addfile(info, io.BytesIO(data))


@pytest.fixture()
def folder(tmp_path):
    write_tar(
        tmp_path / "shard-000000.tar",
        [
            ("a.png", PNG),
            ("a.txt", "é a".encode()),
            ("b.jpeg", PNG),
            ("b.txt", b"b"),
            ("no_txt.png", PNG),
            ("no_image.txt", b"n"),
        ],
    )
    write_tar(
        tmp_path / "shard-000001.tar",
        [("bad.png", b"junk"), ("bad.txt", b"x"), ("f.latent.bin", b"\x01"), ("f.txt", b"f"), ("d/g.png", PNG)],
    )
    return str(tmp_path)


def test_samples(spark, folder):
    got = {r.key: r for r in tar.tar_scan(spark, folder, sizes=True, bad_samples="keep").collect()}
    assert set(got) == {"a", "b", "no_txt", "no_image", "bad", "f", "d/g"}
    assert got["a"].fields["txt"].decode() == "é a" and (got["a"].height, got["a"].width) == (2, 3)
    assert got["b"].members == ["jpeg", "txt"]
    assert bytes(got["f"].fields["latent.bin"]) == b"\x01"
    assert got["bad"]._error and got["bad"].height is None
    assert (got["a"].shard_idx, got["f"].shard_idx) == (0, 1)
    assert got["a"].pos == 0 < got["b"].pos


def test_uris_and_globs(spark, folder):
    assert tar.tar_scan(spark, f"file://{folder}").select("key").distinct().count() == 6 + 1
    assert tar.count_shards([f"file://{folder}/shard-00000[01].tar", folder]) == 4


def test_hooks_of_the_training_plan(spark, tmp_path):
    """Subject training: own buckets and own captions."""
    write_tar(tmp_path / "shard-000000.tar", [m for i in range(6) for m in ((f"{i}.png", PNG), (f"{i}.txt", b"a dog"))])

    def place(rows):
        return rows.withColumns({"bucket": F.lit(7.0), "target_height": F.lit(2), "target_width": F.lit(2)})

    rows = training.training_batches(
        spark,
        str(tmp_path),
        Bins.from_sizes([(1, 1)]),
        2,
        4,
        lambda: lambda pictures: [[float(p.shape[1])] for p in pictures],
        lambda: lambda texts: [[[float(len(t))]] for t in texts],
        2,
        3,
        place=place,
        caption=lambda text: captions.class_label(text, "dog", "sks"),
    ).collect()
    # One shard and two ranks: both read it, and each fills one batch of four.
    assert sorted((r["rank"], r.slot, r.key) for r in rows) == [(k, i, str(i)) for k in range(2) for i in range(4)]
    assert {(r.bucket, r.caption, r.emb[0][0]) for r in rows} == {(7.0, "a sks dog", 9.0)}


def test_required_and_first_present(spark, folder):
    rows = tar.tar_scan(spark, folder).select(
        "key", fields.first_present(F.col("fields")).alias("image"), fields.text_field(F.col("fields")).alias("caption")
    )
    assert {r.key for r in fields.required_fields(rows).collect()} == {"a", "b", "bad"}


def test_only_wanted_bodies(spark, folder):
    got = {r.key: r for r in tar.tar_scan(spark, folder, fields=["txt"]).collect()}
    assert list(got["a"].fields) == ["txt"] and got["a"].members == ["png", "txt"]


def test_quarantine(spark, folder):
    only = tar.tar_scan(spark, folder, sizes=True, bad_samples="only").collect()
    assert [r.key for r in only] == ["bad"]


def test_cut_off_shard(spark, tmp_path):
    write_tar(tmp_path / "x.tar", [(f"{i}.txt", b"t" * 600) for i in range(10)])
    data = (tmp_path / "x.tar").read_bytes()
    (tmp_path / "x.tar").write_bytes(data[: 512 * 12 + 700])
    rows = tar.tar_scan(spark, str(tmp_path), bad_samples="keep").collect()
    assert [r.key for r in rows if r._error is None] == ["0", "1", "2", "3"]
    assert [r.key for r in rows if r._error] == ["4"]


def test_missing_paths(spark, folder):
    paths = [f"{folder}/shard-000000.tar", f"{folder}/absent.tar"]
    assert tar.tar_scan(spark, paths, ignore_missing=True).count() == 4
    with pytest.raises(Exception, match="absent"):
        tar.tar_scan(spark, paths).count()
    assert tar.tar_scan(spark, f"{folder}/shard-00000[01].tar").select("shard").distinct().count() == 2


@pytest.mark.parametrize("split_bytes", [512, 1536, 5000, 1 << 20])
def test_splits_own_each_sample_once(spark, tmp_path, split_bytes):
    # A float time and long names bring extension headers before members.
    members = []
    for i in range(60):
        key = f"{i:03d}" if i % 3 else f"{'long' * 40}{i:03d}"
        members += [(f"{key}.txt", b"t" * (i * 37 % 1500)), (f"{key}.png", PNG)]
    write_tar(tmp_path / "s.tar", members, mtime=1.5)
    whole = tar.tar_scan(spark, str(tmp_path)).orderBy("pos").collect()
    split = tar.tar_scan(spark, str(tmp_path), split_bytes=split_bytes).orderBy("pos").collect()
    assert len(whole) == 60
    assert [(r.key, r.pos, r.members, r.fields) for r in split] == [(r.key, r.pos, r.members, r.fields) for r in whole]


def test_members_are_fetched_by_place(spark, folder):
    index = tar.tar_scan(spark, folder, fields=[]).select("shard", "pos", "key")
    fetched = {r.key: r.fields for r in tar.with_members(index.orderBy(F.desc("pos")), ["txt", "png"]).collect()}
    whole = {r.key: r.fields for r in tar.tar_scan(spark, folder, fields=["txt", "png"]).collect()}
    assert fetched == whole


def test_write_and_read_back(spark, tmp_path):
    rows = [(n, p, f"{p:06d}", f"text {n} {p}", bytearray([n, p])) for n in range(3) for p in range(4)]
    df = spark.createDataFrame(rows, "shard_no long, shard_pos long, shard_key string, txt string, latent__bin binary")
    out = str(tmp_path / "out")
    tar.write_shards(tar.by_shard(df), out, ["txt", "latent__bin"])
    got = tar.tar_scan(spark, out).orderBy("shard_idx", "pos").collect()
    assert [(r.shard_idx, r.key, r.fields["txt"].decode(), bytes(r.fields["latent.bin"])) for r in got] == [
        (n, key, txt, bytes(b)) for n, _, key, txt, b in rows
    ]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"shard-{n:06d}.tar" for n in range(3)]
    # Overwriting removes shards that the new data lacks.
    tar.write_shards(tar.by_shard(df.filter("shard_no = 1")), out, ["txt"], mode="overwrite")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["shard-000001.tar"]


def test_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, "a", "x")], "shard_no long, shard_pos long, shard_key string, txt string")
    broken = df.withColumn("txt", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        tar.write_shards(broken, str(tmp_path / "out"), ["txt"])
    assert not [p for p in (tmp_path / "out").glob("*")]


def plain_rows(spark, path, **options):
    rows = tar.tar_scan(spark, str(path), bad_samples="keep", **options).orderBy("pos").collect()
    return [(r.key, r.pos, r.members, r.fields, r._error) for r in rows]


def damaged(path, number, count=20, flip=True):
    """A shard of ``count`` samples of two members; the header of member ``number`` is damaged."""
    write_tar(path, [m for i in range(count) for m in ((f"{i:02d}.txt", b"t" * 700), (f"{i:02d}.png", PNG))])
    if flip:
        with tarfile.open(path) as archive:
            at = archive.getmembers()[number].offset
        data = bytearray(path.read_bytes())
        data[at + 3] ^= 0xFF
        path.write_bytes(bytes(data))


@pytest.mark.parametrize("number", [0, 1, 2, 13, 39])
def test_damaged_header_costs_two_samples_at_most(spark, tmp_path, number):
    damaged(tmp_path / "s.tar", number)
    rows = plain_rows(spark, tmp_path)
    good = [r for r in rows if r[4] is None]
    own = f"{number // 2:02d}"
    assert all(len(r[2]) == 2 for r in good) and own not in {r[0] for r in good}
    assert 18 <= len(good) and any(r[4] for r in rows)
    for split_bytes in (512, 5000):
        assert plain_rows(spark, tmp_path, split_bytes=split_bytes) == rows


@pytest.mark.parametrize("kind", ["unmarked", "long_pax", "nested"])
def test_splits_of_odd_shards(spark, tmp_path, kind):
    path = tmp_path / "s.tar"
    if kind == "nested":  # bodies that are tar files themselves
        inner = io.BytesIO()
        with tarfile.open(fileobj=inner, mode="w") as archive:
            for i in range(3):
                info = tarfile.TarInfo(f"inner{i}.txt")
                info.size = 4
                archive.addfile(info, io.BytesIO(b"data"))
        write_tar(path, [(f"{i}.tar", inner.getvalue()) for i in range(8)])
    elif kind == "long_pax":
        with tarfile.open(path, "w", format=tarfile.PAX_FORMAT) as archive:
            for i in range(12):
                info = tarfile.TarInfo(f"{i:02d}.txt")
                info.size, info.pax_headers = 600, {"SCHILY.xattr.user.note": "n" * 6000}
                archive.addfile(info, io.BytesIO(b"t" * 600))
    else:
        damaged(path, 0, flip=False)
        data = bytearray(path.read_bytes())
        with tarfile.open(path) as archive:
            offsets = [m.offset for m in archive]
        for at in offsets:
            data[at + 257 : at + 265] = bytes(8)
            data[at + 148 : at + 156] = b" " * 8
            data[at + 148 : at + 156] = b"%06o\0 " % sum(data[at : at + 512])
        path.write_bytes(bytes(data))
    whole = plain_rows(spark, tmp_path)
    assert len(whole) == {"nested": 8, "long_pax": 12, "unmarked": 20}[kind] and not any(r[4] for r in whole)
    for split_bytes in (512, 3000, 7000, 20_000):
        assert plain_rows(spark, tmp_path, split_bytes=split_bytes) == whole


def test_errors_of_the_store_are_raised(tmp_path, monkeypatch):
    damaged(tmp_path / "s.tar", 0, flip=False)
    path = str(tmp_path / "s.tar")

    class Stream:
        def __init__(self, inner):
            self.inner = inner

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.inner.close()

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def read(self, size=-1):
            if self.inner.tell() > 20_000:
                raise OSError("connection lost")
            return self.inner.read(size)

    class Store:
        def open_input_file(self, inside):
            return Stream(open(inside, "rb"))

    Stream.size = lambda self: (tmp_path / "s.tar").stat().st_size
    monkeypatch.setattr(tar, "open_store", lambda _: (Store(), path))
    with pytest.raises(OSError, match="connection lost"):
        list(tar._Samples(None, False).read(tar.TarSplit(path, 0, 0, 1 << 40)))


def test_size_is_of_the_image_that_is_taken(spark, tmp_path):
    small, large = png_bytes(np.zeros((4, 9, 3), np.uint8)), png_bytes(np.zeros((7, 3, 3), np.uint8))
    write_tar(tmp_path / "s.tar", [("a.png", small), ("a.jpg", large), ("b.png", b"junk"), ("b.jpg", large), ("c.jpeg", b"junk"), ("c.png", small)])
    rows = {r.key: (r.height, r.width, r._error is None) for r in tar.tar_scan(spark, str(tmp_path), sizes=True, bad_samples="keep").collect()}
    assert rows == {"a": (7, 3, True), "b": (7, 3, True), "c": (None, None, False)}


def test_append_goes_on_numbering(spark, tmp_path):
    df = spark.createDataFrame([(n, 0, "k", f"first {n}") for n in range(3)], "shard_no long, shard_pos long, shard_key string, txt string")
    out = tmp_path / "out"
    tar.write_shards(tar.by_shard(df), str(out), ["txt"])
    before = {p.name: p.read_bytes() for p in out.iterdir()}
    tar.write_shards(tar.by_shard(df.filter("shard_no = 0").withColumn("txt", F.lit("second"))), str(out), ["txt"])
    after = {p.name: p.read_bytes() for p in out.iterdir()}
    assert sorted(after) == [f"shard-{n:06d}.tar" for n in range(4)] and all(after[n] == b for n, b in before.items())
    got = tar.tar_scan(spark, str(out)).orderBy("shard_idx").collect()
    assert [r.fields["txt"] for r in got] == [b"first 0", b"first 1", b"first 2", b"second"]
