"""Batches of one bucket each: per table, per rank, and in step over ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framekiln.functions.draws import draw_hex, hex_block
from framekiln.operators.numbering import BLOCK_ROWS, with_ordinal

ARRIVAL = ("shard_idx", "pos")


def _slots(df: DataFrame, size: int, batch: str = "batch_no", slot: str = "slot") -> DataFrame:
    whole = F.floor(F.col("__total") / F.lit(size))
    return (
        df.withColumns({batch: F.floor(F.col("__at") / F.lit(size)), slot: F.pmod(F.col("__at"), F.lit(size))})
        .filter(F.col(batch) < whole)
        .drop("__at", "__total")
    )


def bucket_batches(
    df: DataFrame,
    batch_size: int,
    bucket: str = "bucket",
    order: Sequence[str] = ARRIVAL,
    rank: str | None = None,
    block_rows: int = BLOCK_ROWS,
    blocks=None,
) -> DataFrame:
    """Number the rows of a bucket in arrival order and cut them into full batches.

    Adds ``batch_no`` and ``slot``. The incomplete tail of a bucket is left out, as
    a trainer never receives it. With ``rank`` each rank fills its own batches.
    """
    group = [rank, bucket] if rank else [bucket]
    numbered = with_ordinal(df, order, group, "__at", "__total", blocks, block_rows)
    return _slots(numbered, batch_size)


def sync_batches(
    df: DataFrame,
    ranks: int,
    batch_size: int,
    bucket: str = "bucket",
    rank: str = "rank",
    order: Sequence[str] = ARRIVAL,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Batches kept in step over ranks, without loss inside a batch.

    Batch n of a bucket exists only if every rank can fill it, so all ranks get the
    same number of batches per bucket. The shared number comes with the row numbers, so
    rows are shuffled once.
    """
    def shared(blocks: DataFrame) -> DataFrame:
        # One row per block: the least whole number of batches over all ranks.
        same = Window.partitionBy(bucket)
        whole = F.floor(F.min("__total").over(same) / F.lit(batch_size))
        present = F.size(F.collect_set(rank).over(same)) == ranks
        return blocks.withColumn("__shared", F.when(present, whole).otherwise(F.lit(0)))

    numbered = with_ordinal(df, order, [rank, bucket], "__at", "__total", block_rows=block_rows, extend=shared)
    return _slots(numbered, batch_size).filter(F.col("batch_no") < F.col("__shared")).drop("__shared")


def repeat_batches(
    df: DataFrame,
    batch_size: int,
    ranks: int,
    repeats: int = 5,
    bucket: str = "bucket",
    order: Sequence[str] = ARRIVAL,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Replay each full super-batch of ``batch_size * ranks`` rows ``repeats`` times.

    Adds ``super_batch``, ``repeat``, ``sub_batch`` (counted through all repeats of a
    super-batch) and ``slot``. Encode before the replay: it only copies rows.
    """
    full = with_ordinal(df, order, [bucket], "__at", "__total", block_rows=block_rows)
    supers = _slots(full, batch_size * ranks, "super_batch", "__slot")
    return (
        supers.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn("sub_batch", F.col("repeat") * ranks + F.floor(F.col("__slot") / F.lit(batch_size)))
        .withColumn("slot", F.pmod(F.col("__slot"), F.lit(batch_size)))
        .drop("__slot")
    )


def collate(
    batches: DataFrame, columns: Sequence[str], batch: Sequence[str] = ("bucket", "batch_no"), slot: str = "slot"
) -> DataFrame:
    """One row per batch, with one array per column in slot order.

    A group is one batch, so its size is the batch size.
    """
    rows = F.sort_array(F.collect_list(F.struct(slot, *columns)))
    packed = batches.groupBy(*batch).agg(rows.alias("__rows"))
    return packed.select(*batch, *[F.col(f"__rows.{c}").alias(c) for c in columns])


def micro_batches(df: DataFrame, image_max: int, text_max: int, slot: str = "slot") -> DataFrame:
    """Add the slice numbers in which images and captions of a batch are encoded."""
    return df.withColumns(
        {
            "image_slice": F.floor(F.col(slot) / F.lit(image_max)),
            "text_slice": F.floor(F.col(slot) / F.lit(text_max)),
        }
    )


def step_limit(
    batches: DataFrame,
    steps: int,
    seed: int,
    accumulation: int = 1,
    batch: Sequence[str] = ("bucket", "batch_no"),
    slot: str = "slot",
) -> DataFrame:
    """Order all batches by a seeded draw and keep exactly ``steps * accumulation``.

    Adds ``batch_seq``. Only the batch names are numbered; their rows join back.
    """
    names = batches.filter(F.col(slot) == 0).select(*batch)
    drawn = names.withColumn("__draw", draw_hex(seed, *batch))
    numbered = with_ordinal(drawn, ["__draw", *batch], name="batch_seq", blocks=[hex_block("__draw")])
    kept = numbered.filter(F.col("batch_seq") < steps * accumulation).drop("__draw")
    return batches.join(kept, list(batch))
