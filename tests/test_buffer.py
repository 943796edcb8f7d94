"""Buffer shuffle, shards drawn with replacement, and dropout, by themselves and in the training plan."""

from collections import Counter

from pyspark.sql import functions as F

from framekiln.functions.draws import draw_below
from framekiln.operators import sampling
from framekiln.plans import training


def places(frame, *by):
    return [tuple(r) for r in frame.select(*by, "pos", "place").orderBy(*by, "place").collect()]


def test_buffer_moves_no_row_further(spark):
    df = spark.range(0, 3000, 1, 6).select(F.lit(0).alias("shard_idx"), (F.col("id") * 17).alias("pos"))
    got = places(sampling.shuffle_buffer(df, 3, 50, block_rows=64))
    assert [p for _, p in got] == list(range(3000)) and sorted(p for p, _ in got) == [17 * i for i in range(3000)]
    moves = [place - pos // 17 for pos, place in got]
    assert max(map(abs, moves)) < 50 and len({m for m in moves}) > 60
    assert got == places(sampling.shuffle_buffer(df.repartition(3), 3, 50, block_rows=1000))
    assert got != places(sampling.shuffle_buffer(df, 4, 50)) and got != places(sampling.shuffle_buffer(df, 3, 50, epoch=1))


def test_buffer_in_groups_equals_sorting(spark):
    rows = [(i % 3 and 1, i // 40, i) for i in range(400)]
    df = spark.createDataFrame(rows, "rank int, shard_idx int, pos long")
    drawn = df.withColumn("d", draw_below(9, F.lit(8), F.lit(0), "rank", "shard_idx", "pos")).collect()
    for rank in (0, 1):
        own = sorted((r.shard_idx, r.pos, r.d) for r in drawn if r["rank"] == rank)
        want = [p for _, p in sorted((i + d, i, p) and ((i + d, i), p) for i, (_, p, d) in enumerate(own))]
        got = places(sampling.shuffle_buffer(df, 8, 9, group=["rank"]).filter(F.col("rank") == rank))
        assert [p for p, _ in got] == want
    assert places(sampling.shuffle_buffer(df.filter("false"), 8)) == []


def index_of(spark, shards=6, each=30, ranks=2):
    rows = [(s % ranks, s, p, f"{s}-{p}", float((s * each + p) % 3)) for s in range(shards) for p in range(each)]
    return spark.createDataFrame(rows, "rank int, shard_idx int, pos long, key string, bucket double")


def test_plan_with_a_buffer(spark):
    index = index_of(spark)
    got = training.planned_batches(index, 2, 4, epochs=2, seed=5, buffer=12).collect()
    full = Counter((r["rank"], r.bucket, r.batch_no) for r in got)
    assert set(full.values()) == {4}
    assert {(b, n) for _, b, n in full} == {(b, n) for k, b, n in full if k == 0}
    assert max(Counter((r.epoch, r.key) for r in got).values()) == 1 and len(got) >= 2 * 180 - 2 * 3 * 4
    whole = {k: [r for r in got if r["rank"] == k] for k in (0, 1)}
    assert len(whole[0]) == len(whole[1])
    assert got[0].asDict().keys() == training.planned_batches(index, 2, 4, epochs=2, seed=5).first().asDict().keys()


def test_shards_drawn_with_replacement(spark):
    index = index_of(spark)
    drawn = training.drawn_index(index, 3, 8, 6, seed=2)
    want = {(r["rank"], r.draw): r.shard_idx for r in sampling.shard_draws(spark, 3, 8, 6, 2).collect()}
    got = Counter((r["rank"], r.epoch, r.shard_idx) for r in drawn.collect())
    assert got == {(rank, draw, shard): 30 for (rank, draw), shard in want.items()}
    batches = training.planned_batches(drawn, 3, 4, seed=2, buffer=10, steps=6, accumulation=2).collect()
    assert len(batches) == 6 * 2 * 3 * 4
