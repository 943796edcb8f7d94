"""Batches of ranks that advance one row at a time, with surplus rows dropped.

At time t each rank takes its t-th row into a bucket. When every rank holds at least
``batch_size`` rows of a bucket, each emits that many, and the bucket is emptied, so
what a rank held beyond a batch is lost. When the next emission happens depends only
on the time of the last one: it is the largest, over ranks, of the time at which a
rank gets its ``batch_size``-th row since. That makes it

    next(t) = running maximum, over the bucket's rows up to t,
              of the time of the row ``batch_size`` places later in the same rank

which needs no simulation. The emissions are the chain start, next(start), ... . It is
followed inside blocks of time in parallel, and over blocks by doubling, so that no
task sees more than one block of one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framekiln.operators.numbering import BLOCK_ROWS, prefixes, running_max, with_ordinal
from framekiln.session import written

ARRIVAL = ("shard_idx", "pos")
NEVER = (1 << 62) - 1


def _chain(times: np.ndarray, following: np.ndarray, entry: int) -> list[int]:
    """The chain's elements among ``times``, from ``entry`` on."""
    at, found = entry, []
    last = times[-1]
    while at <= last:
        found.append(at)
        at = int(following[np.searchsorted(times, at)])
    return found


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """For each time the first chain element after the block, by pointer doubling."""
    rows = rows.sort_values("t")
    times, following = rows["t"].to_numpy(), rows["following"].to_numpy()
    here = np.arange(len(times))
    # An element whose successor lies outside the block points to itself.
    to = np.where(following <= times[-1], np.searchsorted(times, following), here)
    while True:
        further = to[to]
        if (further == to).all():
            break
        to = further
    return rows.assign(exit=following[to])


def _emissions(candidates: DataFrame, starts: DataFrame, bucket: str, block_rows: int) -> DataFrame:
    """All emission times: ``bucket, t``."""
    blocks = (candidates.agg(F.max("t")).first()[0] or 0) // block_rows + 1
    keys = [bucket, "__block"]
    block = F.floor(F.col("t") / F.lit(block_rows))
    cut = candidates.withColumn("__block", block)
    entries = _entries(cut, starts, bucket, blocks)
    bucket_type = candidates.schema[bucket].dataType.simpleString()

    def walk(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if not len(entry) or not len(rows):
            return pd.DataFrame({bucket: [], "t": []})
        rows = rows.sort_values("t")
        found = _chain(rows["t"].to_numpy(), rows["following"].to_numpy(), int(entry["t"].iloc[0]))
        return pd.DataFrame({bucket: rows[bucket].iloc[0], "t": found})

    return (
        cut.groupBy(*keys)
        .cogroup(entries.withColumn("__block", block).groupBy(*keys))
        .applyInPandas(walk, f"`{bucket}` {bucket_type}, t bigint")
    )


def _entries(cut: DataFrame, starts: DataFrame, bucket: str, blocks: int) -> DataFrame:
    """Where the chain enters each block, at most once per block."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    exits = cut.groupBy(bucket, "__block").applyInPandas(_exits, f"{schema}, `exit` bigint")
    exits = written(exits.select(bucket, "t", "exit"), "lockstep-exits")
    # Chains of a block merge, so few distinct exits are left to follow.
    nodes = exits.filter(F.col("exit") < NEVER).select(bucket, F.col("exit").alias("t")).unionByName(starts).distinct()
    jump = written(exits.join(nodes, [bucket, "t"]).filter(F.col("exit") < NEVER), "lockstep-jump")
    reached = starts
    steps = 1
    while steps < blocks:
        landed = reached.join(jump, [bucket, "t"]).select(bucket, F.col("exit").alias("t"))
        reached = written(reached.unionByName(landed), "lockstep-reached")
        steps *= 2
        if steps < blocks:
            second = jump.select(bucket, F.col("t").alias("exit"), F.col("exit").alias("__far"))
            jump = written(
                jump.join(second, [bucket, "exit"]).select(bucket, "t", F.col("__far").alias("exit")), "lockstep-jump"
            )
    return reached


def lockstep_batches(
    df: DataFrame,
    ranks: int,
    batch_size: int,
    bucket: str = "bucket",
    rank: str = "rank",
    order: Sequence[str] = ARRIVAL,
    overflow: str = "oldest",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Batches as ranks in step emit them; adds ``batch_no`` and ``slot``.

    ``overflow`` says which rows of a rank that holds more than a batch are emitted:
    the ``oldest``, or the ``newest`` as with bounded buffers. (rank, *order) names a
    row. Intermediate tables hold only these columns; they go to the shared folder,
    and small jobs run while the plan is built.
    """
    if overflow not in ("oldest", "newest"):
        raise ValueError("overflow is 'oldest' or 'newest'")
    narrow = df.select(rank, bucket, *order)
    timed = with_ordinal(narrow, order, [rank], name="t", block_rows=block_rows)
    rows = written(with_ordinal(timed, ["t"], [bucket, rank], name="k", block_rows=block_rows), "lockstep-rows")

    starts = (
        rows.filter(F.col("k") == batch_size - 1)
        .groupBy(bucket)
        .agg(F.max("t").alias("t"), F.count(F.lit(1)).alias("__ranks"))
        .filter(F.col("__ranks") == ranks)
        .select(bucket, "t")
    )
    later = rows.select(bucket, rank, (F.col("k") - batch_size).alias("k"), F.col("t").alias("__later"))
    candidates = (
        rows.join(later, [bucket, rank, "k"], "left")
        .groupBy(bucket, "t")
        .agg(F.max(F.coalesce("__later", F.lit(NEVER))).alias("__least"))
        .join(starts.select(bucket), bucket, "left_semi")
    )
    following = written(
        running_max(candidates, "__least", "t", [bucket], "following", block_rows).drop("__least"), "lockstep-next"
    )
    emitted = written(_emissions(following, starts, bucket, block_rows), "lockstep-emitted")

    windowed = _windows(rows, emitted, bucket, rank, order, block_rows)
    shift = batch_size if overflow == "oldest" else -batch_size
    other = windowed.select(bucket, rank, (F.col("k") + shift).alias("k"), F.col("batch_no").alias("__other"))
    outside = F.col("__other").isNull() | (F.col("__other") != F.col("batch_no"))
    kept = (
        windowed.join(other, [bucket, rank, "k"], "left")
        .filter(outside & (F.col("batch_no") < F.col("__emitted")))
        # Now each (bucket, rank, batch) has exactly batch_size rows.
        .withColumn("slot", F.row_number().over(Window.partitionBy(bucket, rank, "batch_no").orderBy("k")) - 1)
        .select(rank, bucket, *order, "batch_no", "slot")
    )
    if set(df.columns) == {rank, bucket, *order}:
        return kept
    return df.join(kept.drop(bucket), [rank, *order])


def _windows(rows: DataFrame, emitted: DataFrame, bucket: str, rank: str, order: Sequence[str], block_rows: int) -> DataFrame:
    """Each row with the number of emissions before its time, as ``batch_no``."""
    kinds = rows.withColumn("__mark", F.lit(0)).unionByName(
        emitted.withColumn("__mark", F.lit(1)), allowMissingColumns=True
    )
    cut = kinds.withColumn("__block", F.floor(F.col("t") / F.lit(block_rows)))
    keys = [bucket, "__block"]
    marks = cut.groupBy(*keys).agg(F.sum("__mark").alias("__marks"))
    offsets = prefixes(marks, [bucket], ["__block"], "__marks", total="__emitted")
    offsets = offsets.select(*keys, F.coalesce("__offset", F.lit(0)).alias("__offset"), "__emitted")
    # An emission at time t comes after the rows of time t.
    inside = Window.partitionBy(*keys).orderBy("t", "__mark").rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumn("__inside", F.sum("__mark").over(inside))
        .filter(F.col("__mark") == 0)
        .join(offsets, keys)
        .withColumn("batch_no", F.col("__offset") + F.col("__inside"))
        .select(rank, bucket, *order, "t", "k", "batch_no", "__emitted")
    )
