"""Lockstep batches against a plain loop over ranks and rows."""

import random

import pytest

from framekiln.operators.lockstep import lockstep_batches


def by_loop(rows, ranks, size, overflow):
    """rows: (rank, bucket, pos). Returns {(rank, pos): (bucket, batch_no, slot)}."""
    streams = [sorted((p, b) for r, b, p in rows if r == rank) for rank in range(ranks)]
    held, emitted, out = {}, {}, {}
    for t in range(max(map(len, streams))):
        for rank, stream in enumerate(streams):
            if t < len(stream):
                pos, bucket = stream[t]
                held.setdefault(bucket, [[] for _ in range(ranks)])[rank].append(pos)
        for bucket, lists in held.items():
            if min(map(len, lists)) >= size:
                number = emitted.get(bucket, 0)
                emitted[bucket] = number + 1
                for rank, places in enumerate(lists):
                    chosen = places[:size] if overflow == "oldest" else places[-size:]
                    for slot, pos in enumerate(chosen):
                        out[rank, pos] = (bucket, number, slot)
                    places.clear()
    return out


@pytest.mark.parametrize("overflow", ["oldest", "newest"])
@pytest.mark.parametrize("seed, block_rows", [(1, 1 << 16), (2, 16), (3, 5)])
def test_equals_the_loop(spark, overflow, seed, block_rows):
    rng = random.Random(seed)
    ranks, size = 3, 2
    rows = []
    for rank in range(ranks):
        # Ranks of unlike length and mix, with one hot bucket.
        weights = [rng.randint(1, 6) for _ in range(4)]
        weights[0] += 8
        for i in range(rng.randint(120, 200)):
            rows.append((rank, rng.choices([0.5, 1.0, 2.0, 4.0], weights)[0], i * ranks + rank))
    # A bucket that one rank never sees emits nothing.
    rows += [(rank, 9.0, 10_000 + 10 * i + rank) for rank in range(2) for i in range(10)]
    df = spark.createDataFrame([(r, b, 0, p) for r, b, p in rows], "rank int, bucket double, shard_idx int, pos long")
    got = lockstep_batches(df, ranks, size, overflow=overflow, block_rows=block_rows).collect()
    want = by_loop(rows, ranks, size, overflow)
    assert len(got) == len(want) > 0
    assert {(r.rank, r.pos): (r.bucket, r.batch_no, r.slot) for r in got} == want


def test_other_columns_come_along(spark):
    rows = [(i % 2, 1.0, 0, i, f"k{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "rank int, bucket double, shard_idx int, pos long, key string")
    got = lockstep_batches(df, 2, 3).collect()
    assert len(got) == 18
    assert all(r.key == f"k{r.pos}" for r in got)
