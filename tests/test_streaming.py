import pytest
from pyspark.sql import functions as F

from framekiln.session import fresh_path
from framekiln.streaming import arrival, batcher, committed, losses, reshard, sinks

SCHEMA = "rank int, bucket string, shard_idx int, pos long"


def add_file(spark, path, shard, rows):
    df = spark.createDataFrame([(r, b, shard, p) for r, b, p in rows], SCHEMA).coalesce(1)
    df.write.mode("append").parquet(path)


@pytest.fixture()
def folder(spark):
    return fresh_path(spark, "test-stream")


def test_state_carries_over_files_and_restarts(spark, folder):
    source, table, mark = f"{folder}/in", f"{folder}/out", f"{folder}/mark"
    add_file(spark, source, 0, [(i % 2, "a" if i % 5 else "b", i) for i in range(50)])

    def run():
        stream = batcher.stream_bucket_batches(arrival.arriving_rows(spark, source, SCHEMA), 8)
        sinks.drain(stream, table, mark)
        return spark.read.parquet(table).collect()

    first = run()
    add_file(spark, source, 1, [(i % 2, "a" if i % 5 else "b", i) for i in range(50, 110)])
    both = run()
    assert len(first) < len(both)
    batches = {}
    for r in both:
        batches.setdefault((r["rank"], r.bucket, r.batch_no), []).append((r.slot, r.pos))
    assert all([s for s, _ in sorted(v)] == list(range(8)) for v in batches.values())
    for rank in (0, 1):
        for bucket in "ab":
            arrived = [i for i in range(110) if i % 2 == rank and ("a" if i % 5 else "b") == bucket]
            got = [p for k in sorted(k for k in batches if k[:2] == (rank, bucket)) for _, p in sorted(batches[k])]
            # Files arrive in order, so the stream equals batching the whole table.
            assert got == arrived[: len(arrived) // 8 * 8]


def test_bounded_state_keeps_the_newest(spark, folder):
    source, table, mark = f"{folder}/in", f"{folder}/out", f"{folder}/mark"

    def run():
        sinks.drain(batcher.stream_bounded_batches(arrival.arriving_rows(spark, source, SCHEMA), 2, 3), table, mark)
        return sorted((r["rank"], r.batch_no, r.slot, r.pos) for r in spark.read.parquet(table).collect())

    # Rank 0 runs ahead of rank 1; the batch leaves with the third row of rank 1, not with the trigger.
    add_file(spark, source, 0, [(0, "a", i) for i in range(10)])
    assert run() == []
    add_file(spark, source, 1, [(1, "a", 100 + i) for i in range(4)])
    first = [(0, 0, s, 7 + s) for s in range(3)] + [(1, 0, s, 100 + s) for s in range(3)]
    assert run() == first
    add_file(spark, source, 2, [(0, "a", 200 + i) for i in range(3)] + [(1, "a", 300 + i) for i in range(2)])
    assert run() == sorted(first + [(0, 1, s, 200 + s) for s in range(3)] + [(1, 1, s, p) for s, p in enumerate([103, 300, 301])])


@pytest.mark.parametrize("files", [1, 10])
def test_bounded_batches_do_not_depend_on_triggers(spark, oracle, sf_dir, files):
    from workload import streams
    from workload.registry import ORACLES

    stream = batcher.stream_bounded_batches(streams.events_in_steps(spark, sf_dir, files), 4, 16, order=["step"])
    got = sinks.drained(spark, stream, "stream-bounded").select("bucket", "batch_no", "rank", "slot", "pos").collect()
    assert sorted(map(tuple, got)) == sorted(oracle.execute(ORACLES["stream_bounded"]).fetchall())


def test_reshard_numbers_go_on_after_a_restart(spark, folder):
    source, table, mark = f"{folder}/in", f"{folder}/out", f"{folder}/mark"
    for shard, begin in enumerate((0, 7)):
        add_file(spark, source, shard, [(0, "a", i) for i in range(begin, begin + 7)])
        stream = reshard.stream_reshard(arrival.arriving_rows(spark, source, SCHEMA), 5)
        sinks.drain(stream, table, mark, ["rank", "shard_no"])
    got = spark.read.parquet(table).orderBy("pos").collect()
    assert [(r.shard_no, r.shard_pos, r.shard_key) for r in got] == [(i // 5, i % 5, f"{i % 5:06d}") for i in range(14)]


def test_losses(spark, folder):
    schema = "rank int, micro long, loss double"
    rows = [(r, m, float(r + m)) for r in range(2) for m in range(5)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/log")
    log = arrival.arriving_rows(spark, f"{folder}/log", schema, max_files=1)
    got = sinks.drained(spark, losses.step_losses(log, 2, 2), "test-loss").orderBy("step").collect()
    # Step 2 has one micro-step of two, so it is not complete.
    assert [(r.step, r.loss) for r in got] == [(0, 2.0), (1, 6.0)]
    query = (
        losses.running_loss(log, 2, 2).writeStream.format("memory").queryName("running").outputMode("complete")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert {r.step: (r.loss, r.rows) for r in spark.table("running").collect()} == {0: (2.0, 4), 1: (6.0, 4), 2: (4.5, 2)}
    assert spark.table("running").agg(F.count(F.lit(1))).first()[0] == 3


LOG = "rank int, micro long, loss double"


def test_updates_merge_by_step_and_go_on_after_a_restart(spark, folder):
    def run(rows):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        stream = losses.step_updates(arrival.arriving_rows(spark, f"{folder}/log", LOG, max_files=1), 2, 2)
        committed.run_updates(stream, f"{folder}/table", f"{folder}/mark")
        latest = committed.latest_rows(spark, f"{folder}/table", stream.schema, ["step"])
        return {r.step: (r.loss, r.rows) for r in latest.collect()}, stream.schema

    first, schema = run([(r, m, float(r + m)) for r in range(2) for m in range(5)])
    assert first == {0: (2.0, 4), 1: (6.0, 4), 2: (4.5, 2)}
    second, _ = run([(r, 5, 10.0) for r in range(2)])
    assert second == {0: (2.0, 4), 1: (6.0, 4), 2: (14.5, 4)}
    # Files of a batch without a manifest, as a killed one leaves them, do not count.
    spark.createDataFrame([(0, 99.0, 1)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/table/parts")
    latest = committed.latest_rows(spark, f"{folder}/table", schema, ["step"]).collect()
    assert {r.step: (r.loss, r.rows) for r in latest} == second
    committed.compact_updates(spark, f"{folder}/table", schema, ["step"], f"{folder}/small")
    assert {r.step: (r.loss, r.rows) for r in spark.read.parquet(f"{folder}/small").collect()} == second
    assert committed.latest_rows(spark, f"{folder}/none", schema, ["step"]).collect() == []


def test_a_batch_commits_once(spark, folder):
    import pyarrow as pa

    schema = spark.createDataFrame([], "step long, loss double").schema
    writer = committed._UpdateWriter({"path": folder}, schema)
    row = pa.RecordBatch.from_pylist([{"step": 1, "loss": 2.0}])
    first, again, other = (writer.write(iter([row])) for _ in range(3))
    writer.commit([first, None], 0)
    writer.commit([again, None], 0)  # Spark runs the batch again
    writer.abort([other], 1)
    parts = [p for p in __import__("os").listdir(f"{folder}/parts") if p.endswith(".parquet")]
    assert [f"parts/{p}" for p in parts] == [first.entries[0][0]] and list(committed.committed(folder)) == [0]


def test_shards_from_a_stream_hold_each_sample_once(spark, tmp_path):
    import io
    import tarfile

    from framekiln.sources import tar

    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def add(number, begin, count):
        with tarfile.open(source / f"s-{number:03d}.tar", "w") as archive:
            for i in range(begin, begin + count):
                info = tarfile.TarInfo(f"{i:04d}.txt")
                info.size = 4
                archive.addfile(info, io.BytesIO(b"%04d" % i))

    def run():
        narrow = arrival.arriving_shards(spark, str(source), fields=[], bad_samples="drop")
        narrow = narrow.select((F.col("shard_idx") % 2).alias("rank"), F.lit("all").alias("bucket"), "shard_idx", "pos", "shard")
        committed.stream_to_shards(batcher.stream_bucket_batches(narrow, 4), str(out), str(tmp_path / "mark"), ["txt"])
        found = {}
        for path in sorted(out.glob("rank-*/shard-*.tar")):
            rows = tar.tar_scan(spark, str(path), fields=["txt"]).orderBy("pos").collect()
            assert [r.key for r in rows] == [f"{i:06d}" for i in range(4)]
            found[str(path.relative_to(out))] = [int(r.fields["txt"]) for r in rows]
        return found

    add(0, 0, 7), add(1, 100, 5)
    assert run() == {"rank-00000/shard-000000.tar": [0, 1, 2, 3], "rank-00001/shard-000000.tar": [100, 101, 102, 103]}
    add(2, 7, 6), add(3, 105, 2)
    want = {"rank-00000": list(range(13)), "rank-00001": list(range(100, 107))}
    got = run()
    assert got == {f"{k}/shard-{n:06d}.tar": v[4 * n : 4 * n + 4] for k, v in want.items() for n in range(len(v) // 4)}
    # A batch that was killed before its manifest runs again and makes the same shards.
    last = max(committed.committed(str(out)))
    (out / "commits" / f"{last:012d}.json").unlink()
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "mark" / "commits" / name).unlink()
    assert run() == got and max(committed.committed(str(out))) == last
    assert not list(out.glob("rank-*/.*.part"))
