import math
import random

import pytest

from framekiln.operators import batching, buckets, pairing, sampling, sharding


def ranges(spark, shards, ranks, **options):
    df = spark.range(shards).withColumnRenamed("id", "shard_no")
    out = {r: [] for r in range(ranks)}
    for row in sharding.rank_ranges(df, ranks, **options).collect():
        out[row["rank"]].append(row.shard_no)
    return {r: sorted(v) for r, v in out.items()}


@pytest.mark.parametrize("shards, ranks", [(10, 4), (4, 4), (11, 3), (7, 1)])
def test_ranges_cover_each_shard_once(spark, shards, ranks):
    got = ranges(spark, shards, ranks)
    assert sum(got.values(), []) == list(range(shards))
    assert all(len(got[r]) == shards // ranks for r in range(ranks - 1))


def test_few_shards(spark):
    assert ranges(spark, 2, 3) == {r: [0, 1] for r in range(3)}
    assert ranges(spark, 2, 3, when_few="last") == {0: [], 1: [], 2: [0, 1]}


def test_shard_range_names(spark):
    assert [r.shard for r in sharding.shard_range(spark, 9, 11, "a/").orderBy("shard_no").collect()] == [
        "a/shard-000009.tar",
        "a/shard-000010.tar",
    ]


def test_shard_draws_depend_on_rank_and_seed_only(spark):
    def drawn(seed):
        return {(r["rank"], r.draw): r.shard_idx for r in sampling.shard_draws(spark, 3, 200, 7, seed).collect()}

    once = drawn(1)
    assert once == drawn(1) and len(once) == 600 and set(once.values()) == set(range(7))
    # A rank's seed is the sum of both, so rank 1 of seed 1 draws like rank 0 of seed 2.
    other = drawn(2)
    assert all(once[1, i] == other[0, i] for i in range(200))


def test_nearest_bin_rules(spark):
    bins = buckets.Bins.from_mapping({"1.0": [8, 8], "0.5": [4, 8], "2.0": [8, 4]})
    df = spark.createDataFrame([(0.75,), (1.5,), (0.1,), (1e6,), (None,), (1001.9,)], "ratio double")
    got = [r.bucket for r in buckets.nearest_bin(df, bins).collect()]
    # Ties go to the first bin; nothing near enough, or no ratio, is the fallback.
    assert got == [1.0, 1.0, 0.5, -1.0, -1.0, 2.0]
    loose = [r.bucket for r in buckets.nearest_bin(df, bins, limit=100.0, fallback=0.6).collect()]
    assert loose == [1.0, 1.0, 0.5, 0.6, 0.6, 0.6]


@pytest.mark.parametrize("seed", range(4))
def test_nearest_bin_equals_the_smallest_distance(spark, seed):
    rng = random.Random(seed)
    ratios = [rng.randrange(1, 40) / rng.choice([4, 7, 8, 10]) for _ in range(20)]
    # Exact middles, their neighbours, and arbitrary values.
    probes = [(a + b) / 2 for a in ratios for b in ratios] + [rng.uniform(0, 12) for _ in range(300)]
    probes += [math.nextafter(p, side) for p in probes[:400] for side in (0.0, 99.0)]
    bins = buckets.Bins(tuple((r, i, i) for i, r in enumerate(ratios)))
    df = spark.createDataFrame([(p,) for p in probes], "ratio double")
    for r in buckets.nearest_bin(df, bins, sizes=True).collect():
        want = min(range(20), key=lambda i: (abs(ratios[i] - r.ratio), i))
        assert (r.bucket, r.target_height) == (ratios[want], want)


def test_bin_table_size_is_checked():
    with pytest.raises(ValueError):
        buckets.Bins.from_sizes([])


def test_a_gap_gives_the_fallback_with_its_size(spark):
    df = spark.createDataFrame([(1.0,), (3.9,), (4.5,), (5.0,), (6.1,), (99.0,), (None,)], "ratio double")
    bins = buckets.Bins.from_sizes([(1, 1), (9, 1)])
    rows = buckets.nearest_bin(df, bins, limit=3.0, fallback=9.0, sizes=True).collect()
    assert [r.bucket for r in rows] == [1.0, 1.0, 9.0, 9.0, 9.0, 9.0, 9.0]
    assert [r.target_height for r in rows] == [1, 1, 9, 9, 9, 9, 9]
    assert [r.bucket for r in buckets.nearest_bin(df, bins, limit=3.0).collect()] == [1.0, 1.0, -1.0, -1.0, 9.0, -1.0, -1.0]


def test_zero_width_is_no_error(spark):
    df = spark.createDataFrame([(4, 0), (4, 2)], "height int, width int")
    got = df.select(buckets.aspect_ratio(df.height, df.width).alias("r")).collect()
    assert [r.r for r in got] == [None, 2.0]


def test_readiness_counts_absent_ranks_as_zero(spark):
    rows = [(1.0, 0)] * 5 + [(1.0, 1)] * 4 + [(2.0, 0)] * 9
    df = spark.createDataFrame(rows, "bucket double, rank int")
    got = {r.bucket: (r.min_rows, r.ready) for r in buckets.bucket_readiness(df, 2, 4).collect()}
    assert got == {1.0: (4, True), 2.0: (0, False)}


def test_batches_are_whole(spark):
    rows = [(i, i // 100, 0.5 if i % 3 else 2.0, i % 2) for i in range(700)]
    df = spark.createDataFrame(rows, "pos long, shard_idx int, bucket double, rank int").repartition(9)
    for rank in (None, "rank"):
        got = batching.bucket_batches(df, 8, rank=rank, block_rows=10).collect()
        assert len({r.pos for r in got}) == len(got)
        slots, counts = {}, {}
        for r in got:
            slots.setdefault((r.bucket, r[rank] if rank else None, r.batch_no), []).append(r.slot)
        assert all(sorted(v) == list(range(8)) for v in slots.values())
        for _, _, b, r in rows:
            counts[b, r if rank else None] = counts.get((b, r if rank else None), 0) + 1
        assert len(got) == sum(n // 8 * 8 for n in counts.values())
    sync = batching.sync_batches(df, 2, 8, block_rows=10).collect()
    per_rank = {}
    for r in sync:
        per_rank.setdefault((r.bucket, r["rank"]), set()).add(r.batch_no)
    assert {len(per_rank[b, 0]) == len(per_rank[b, 1]) for b in (0.5, 2.0)} == {True}


def test_last_caption_wins_among_many_copies(spark):
    rows = [(0, "hot", i, f"c{i}") for i in range(1000)] + [(1, "hot", 0, "other"), (0, "cold", 3, "x")]
    df = spark.createDataFrame(rows, "shard_idx int, key string, pos int, caption string").repartition(5)
    got = {(r.shard_idx, r.key): r.caption for r in pairing.last_wins(df, ["shard_idx", "key"], "pos", "caption").collect()}
    assert got == {(0, "hot"): "c999", (1, "hot"): "other", (0, "cold"): "x"}


def test_listing_suffixes(spark):
    df = spark.createDataFrame([(p,) for p in ("a.tar", "b.zip", "c.txt", "d.jpg", "e.jpeg", "tar", "f.tar.gz")], "path string")
    assert {r.path for r in pairing.shard_listing(df).collect()} == {"a.tar", "b.zip", "c.txt", "d.jpg"}
