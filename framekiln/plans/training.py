"""Batches for training ranks, straight from image-caption shards."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framekiln.functions.draws import draw_hex, draw_int
from framekiln.operators import batching, features, sampling, sharding
from framekiln.operators.buckets import Bins
from framekiln.plans.precompute import encode_batches, image_index, nearest
from framekiln.session import written
from framekiln.sources import tar


def rank_index(
    spark: SparkSession, paths: str | list[str], ranks: int, place: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The image index with the rank that reads each shard."""
    index = image_index(spark, paths, place)
    ranks_of = sharding.readers(F.col("shard_idx"), tar.count_shards(paths), ranks)
    return index.withColumn("rank", F.explode(ranks_of))


def drawn_index(index: DataFrame, ranks: int, draws: int, shards: int, seed: int) -> DataFrame:
    """The index as ranks read it that draw ``draws`` shards each, with replacement: ``rank``, and the draw as ``epoch``."""
    plan = sampling.shard_draws(index.sparkSession, ranks, draws, shards, seed).withColumnRenamed("draw", "epoch")
    return index.drop("rank").distinct().join(plan, "shard_idx")


def planned_batches(
    index: DataFrame,
    ranks: int,
    batch_size: int,
    epochs: int = 1,
    seed: int | None = None,
    steps: int | None = None,
    accumulation: int = 1,
    buffer: int | None = None,
) -> DataFrame:
    """Batches of several epochs in step over ranks; adds ``epoch``, ``batch_no`` and ``slot``.

    With a ``seed`` each rank reads its shards in another order in every epoch, and the samples of
    a shard in another order too; with a ``buffer`` they come in order, shuffled as a reading buffer of that many rows
    does (``shuffle_buffer``), across shards and epochs. Rests of an epoch go on into the next. ``steps`` keeps exactly
    ``steps * accumulation`` batches of each rank, drawn by the seed, the same for all ranks; they are in the
    order of ``batch_seq`` then. An index that has an ``epoch`` (``drawn_index``) is taken as it is. Only narrow index rows are moved.
    """
    rows = index
    if "epoch" not in index.columns:
        rows = index.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    shard = draw_hex(seed, "epoch", "rank", F.lit("shard"), "shard_idx") if seed is not None else F.lpad(F.col("shard_idx").cast("string"), 10, "0")
    if buffer is not None:
        placed = sampling.shuffle_buffer(
            rows.withColumn("__shard", shard), seed or 0, buffer, F.col("epoch"), ["epoch", "__shard", "pos"], ["rank"], ["rank", "shard_idx", "pos"], 1 << 62
        )
        return _limited(batching.sync_batches(placed, ranks, batch_size, order=["place"]).drop("__shard", "place"), steps, seed, accumulation)
    # 31 bits of a draw, then the place in the shard: a total order in one integer.
    draw = F.shiftright(draw_int(seed, "epoch", "rank", "shard_idx", "pos"), 1) if seed is not None else F.lit(0).cast("long")
    rows = rows.withColumns({"__shard": shard, "__place": F.shiftleft(draw, 31) + F.col("pos")})
    dealt = batching.sync_batches(rows, ranks, batch_size, order=["epoch", "__shard", "__place"], block_rows=1 << 62)
    return _limited(dealt.drop("__shard", "__place"), steps, seed, accumulation)


def _limited(dealt: DataFrame, steps: int | None, seed: int | None, accumulation: int) -> DataFrame:
    if steps is None:
        return dealt
    names = written(dealt.filter("rank = 0 AND slot = 0").select("bucket", "batch_no", "slot"), "training-batches")
    kept = batching.step_limit(names, steps, seed or 0, accumulation).select("bucket", "batch_no", "batch_seq")
    return dealt.join(kept, ["bucket", "batch_no"])


def training_batches(
    spark: SparkSession,
    paths: str | list[str],
    bins: Bins,
    ranks: int,
    batch_size: int,
    image_factory: Callable[[], features.Encoder],
    text_factory: Callable[[], features.Encoder],
    image_max: int,
    text_max: int,
    place: Callable[[DataFrame], DataFrame] | None = None,
    caption: Callable[[Column], Column] | None = None,
    epochs: int = 1,
    seed: int | None = None,
    steps: int | None = None,
    accumulation: int = 1,
    buffer: int | None = None,
    draws: int | None = None,
    dropout: tuple[float, Column] | None = None,
) -> DataFrame:
    """Encoded batches in step over ranks: ``rank, bucket, batch_no, slot, shard_idx, key, caption, latent, emb, _error``.

    Rows with an ``_error`` have to be left out or replaced by the reader. ``place`` replaces the choice of bucket (see ``image_index``) and ``caption`` edits
    captions before they are encoded. Any of ``epochs``, ``seed``, ``steps``, ``buffer`` and ``draws`` gives the batches of
    ``planned_batches``, with its columns ``epoch`` and ``batch_seq``; with ``draws`` each rank reads as many shards, drawn with
    replacement. ``dropout`` is a share of batches and the empty caption's embedding that they get (see ``uncond_dropout``).
    """
    index = rank_index(spark, paths, ranks, place or nearest(bins))
    if draws is not None:
        index = drawn_index(index, ranks, draws, tar.count_shards(paths), seed or 0)
    if epochs > 1 or seed is not None or steps is not None or buffer is not None or draws is not None:
        batches = planned_batches(index, ranks, batch_size, epochs, seed, steps, accumulation, buffer)
    else:
        batches = batching.sync_batches(index, ranks, batch_size, block_rows=tar.BLOCK_UNITS)
    rows = encode_batches(
        batches,
        image_factory,
        text_factory,
        image_max,
        text_max,
        batch=("rank", "bucket", "batch_no"),
        tasks=tar.fetch_tasks(index),
        caption=caption,
    )
    if dropout is not None:
        rows = sampling.uncond_dropout(rows, dropout[0], seed or 0, dropout[1])
    planned = [c for c in ("epoch", "batch_seq", "dropped") if c in rows.columns]
    return rows.select("rank", "bucket", "batch_no", "slot", "shard_idx", "key", "caption", "latent", "emb", "_error", *planned)


def feature_batches(
    features_table: DataFrame, batch_size: int, order: Sequence[str] = ("shard_no", "shard_pos"), rank: str | None = None
) -> DataFrame:
    """Full batches of one ratio from precomputed features."""
    return batching.bucket_batches(features_table, batch_size, "ratio", order, rank)
