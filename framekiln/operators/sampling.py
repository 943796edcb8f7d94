"""Shuffles, draws, epochs and mixes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framekiln.functions.draws import draw_below, draw_hex, draw_unit, hex_block
from framekiln.operators.numbering import BLOCK_ROWS, with_ordinal

ARRIVAL = ("shard_idx", "pos")
BUFFER = 1000


def shuffle_global(df: DataFrame, seed: int, epoch: int = 0, key: str = "key", digits: int = 4) -> DataFrame:
    """A seeded shuffle of the whole table; ``place`` is each row's new position.

    ``key`` must be unique. ``digits`` sets the number of blocks, 16 ** digits.
    """
    drawn = df.withColumn("__draw", draw_hex(seed, F.lit(epoch), key))
    return with_ordinal(drawn, ["__draw", key], name="place", blocks=[hex_block("__draw", digits)]).drop("__draw")


def shuffle_block(
    df: DataFrame, seed: int, epoch: int = 0, shard: str = "shard_idx", key: str = "key", digits: int = 2
) -> DataFrame:
    """Shards in seeded order, rows in seeded order inside their shard; adds ``place``."""
    drawn = df.withColumns(
        {
            "__shard_draw": draw_hex(seed, F.lit(epoch), F.lit("shard"), shard),
            "__draw": draw_hex(seed, F.lit(epoch), key),
        }
    )
    blocks = [F.col("__shard_draw"), hex_block("__draw", digits)]
    return with_ordinal(drawn, ["__shard_draw", "__draw", key], name="place", blocks=blocks).drop(
        "__shard_draw", "__draw"
    )


def shuffle_buffer(
    df: DataFrame,
    seed: int,
    buffer: int = BUFFER,
    epoch: int | Column = 0,
    order: Sequence[str] = ARRIVAL,
    group: Sequence[str] = (),
    key: Sequence[str] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """A seeded shuffle like that of a reading buffer: no row moves by ``buffer`` places or more; adds ``place``.

    Each row's place in ``order`` (in its ``group``) is put off by a draw below ``buffer``, and rows are numbered anew by that, the earlier one
    first where it is equal. Rows that are ``buffer`` or more apart keep their order, so this bound holds
    both ways, which a buffer that is read one by one doesn't give. Both numberings run in blocks in parallel. The draw depends on the seed, the
    epoch and the ``key`` (by default group and order), so neither tasks nor restarts change it.
    """
    numbered = with_ordinal(df, order, group, "__at", block_rows=block_rows)
    shift = draw_below(buffer, F.lit(seed), epoch if isinstance(epoch, Column) else F.lit(epoch), *(key or [*group, *order]))
    moved = numbered.withColumn("__to", F.col("__at") + shift)
    blocks = [F.floor(F.col("__to") / F.lit(block_rows))]
    return with_ordinal(moved, ["__to", "__at"], group, "place", blocks=blocks).drop("__at", "__to")


def shard_draw(seed: int, rank: Column, draw: Column, shards: int | Column) -> Column:
    """The shard index of a rank's n-th uniform draw with replacement."""
    return draw_below(shards, F.lit(seed) + rank, draw)


def shard_draws(spark, ranks: int, draws: int, shards: int, seed: int) -> DataFrame:
    """``draws`` shard draws for each rank."""
    plan = spark.range(ranks * draws).select(
        F.floor(F.col("id") / F.lit(draws)).alias("rank"), F.pmod("id", F.lit(draws)).alias("draw")
    )
    return plan.withColumn("shard_idx", shard_draw(seed, F.col("rank"), F.col("draw"), shards))


def epoch_cycle(
    df: DataFrame, epochs: int, order: Sequence[str] = ARRIVAL, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Read all shards in order ``epochs`` times; adds ``epoch`` and the running ``seq``.

    Rows are numbered once, before they are repeated.
    """
    numbered = with_ordinal(df, order, name="__at", total="__total", block_rows=block_rows)
    return (
        numbered.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .withColumn("seq", F.col("epoch") * F.col("__total") + F.col("__at"))
        .drop("__at", "__total")
    )


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """All rows of all sources, duplicates included; adds ``source_idx``."""
    tagged = [df.withColumn("source_idx", F.lit(i)) for i, df in enumerate(sources)]
    return reduce(DataFrame.unionByName, tagged)


def subject_mix(
    instances: DataFrame, regularisation: DataFrame, num_repeats: int, num_passes: int = 1, cycles: int = 1
) -> DataFrame:
    """A cycle is the instance set ``num_repeats`` times, then the regularisation set ``num_passes`` times.

    Adds ``cycle``, ``is_reg`` and ``pass_no``; (cycle, is_reg, pass_no) and the
    set's own order give the reading order.
    """

    def repeated(df: DataFrame, is_reg: bool, times: int) -> DataFrame:
        return (
            df.withColumn("is_reg", F.lit(is_reg))
            .withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))))
            .withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
        )

    return repeated(instances, False, num_repeats).unionByName(repeated(regularisation, True, num_passes))


def uncond_dropout(
    batches: DataFrame,
    probability: float,
    seed: int,
    empty: Column,
    emb: str = "emb",
    batch: Sequence[str] = ("bucket", "batch_no"),
) -> DataFrame:
    """With some probability a whole batch gets the empty caption's embedding.

    One draw per batch. ``empty`` is that one embedding, computed once and given as
    a literal. Adds ``dropped``.
    """
    dropped = batches.withColumn("dropped", draw_unit(seed, *batch) < F.lit(float(probability)))
    return dropped.withColumn(emb, F.when(F.col("dropped"), empty).otherwise(F.col(emb)))
