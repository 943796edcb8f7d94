"""Precomputing features of image-caption shards."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framekiln.functions import fields
from framekiln.operators import batching, features, sharding
from framekiln.operators.buckets import Bins, aspect_ratio, nearest_bin
from framekiln.operators.feature_cache import FeatureCache, keyed
from framekiln.operators.numbering import with_ordinal
from framekiln.session import written
from framekiln.sources import tar


def nearest(bins: Bins, **rule: float) -> Callable[[DataFrame], DataFrame]:
    """The usual way to place samples: the nearest bin, by the rule of ``nearest_bin``."""
    return lambda rows: nearest_bin(rows, bins, sizes=True, **rule)


def image_index(spark: SparkSession, paths: str | list[str], place: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The samples of shards with their bucket and target size, from image headers only.

    Samples that ``rejected_samples`` lists are left out. ``place`` adds ``bucket``,
    ``target_height`` and ``target_width`` to rows with ``height``, ``width`` and
    ``ratio``. The index is written once: batching reads it more than once, and a scan
    opens every shard.
    """
    columns = ["shard", "shard_idx", "pos", "key", "bytes", "bucket", "target_height", "target_width"]
    return written(_placed(spark, paths, place).filter("_error IS NULL").select(*columns), "index")


def rejected_samples(spark: SparkSession, paths: str | list[str], place: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``shard, pos, key, _error`` of the samples that ``image_index`` leaves out, for a quarantine table."""
    return _placed(spark, paths, place).filter("_error IS NOT NULL").select("shard", "pos", "key", "_error")


def _placed(spark: SparkSession, paths: str | list[str], place: Callable[[DataFrame], DataFrame]) -> DataFrame:
    index = tar.tar_scan(spark, paths, fields=[], sizes=True, bad_samples="keep")
    placed = place(index.withColumn("ratio", aspect_ratio(F.col("height"), F.col("width"))))
    problem = (
        F.when(F.col("_error").isNotNull(), F.col("_error"))
        .when(F.col("height").isNull(), F.lit("no image"))
        .when(~F.array_contains("members", "txt"), F.lit("no caption"))
        .when(F.col("target_height").isNull() | F.col("target_width").isNull(), F.lit("no bucket for this shape"))
    )
    return placed.withColumn("_error", problem)


def encode_batches(
    batches: DataFrame,
    image_factory: Callable[[], features.Encoder],
    text_factory: Callable[[], features.Encoder],
    image_max: int,
    text_max: int,
    latent_type: str = "array<float>",
    emb_type: str = "array<array<float>>",
    batch: Sequence[str] = ("bucket", "batch_no"),
    tasks: int | None = None,
    caption: Callable[[Column], Column] | None = None,
    arrange: bool = True,
) -> DataFrame:
    """Fetch the members of batched index rows and add ``caption``, ``latent``, ``emb`` and ``_error``.

    Without ``arrange`` the rows stay in the tasks and the order in which they lie.

    ``caption`` edits the caption before it is encoded. A body that can't be decoded, or a
    caption that is no UTF-8 text, does not end the job: its row says so in ``_error``.
    """
    spread = features.arranged(batches, batch, tasks=tasks) if arrange else batches
    fetched = tar.with_members(spread, [*fields.IMAGE_EXTENSIONS, "txt"])
    text = fields.text_field(F.col("fields"))
    ready = fetched.withColumns(
        {
            "__text": text,
            "caption": caption(F.coalesce(text, F.lit(""))) if caption else F.coalesce(text, F.lit("")),
            "picture": F.struct(
                fields.first_present(F.col("fields")).alias("image"),
                F.col("target_height").alias("height"),
                F.col("target_width").alias("width"),
            ),
        }
    )
    latent = features.encoder(features.image_model(image_factory), latent_type, image_max)
    emb = features.encoder(text_factory, emb_type, text_max)
    encoded = ready.withColumns({"latent": latent(F.col("picture"), F.col("bucket")), "emb": emb(F.col("caption"))})
    problem = F.when(F.col("__text").isNull(), F.lit("the caption is no UTF-8 text")).when(
        F.col("latent").isNull(), F.lit("the image can't be decoded")
    )
    return encoded.withColumn("_error", problem).drop("fields", "picture", "__text")


def in_emission_order(batches: DataFrame, batch_size: int, shard_size: int) -> DataFrame:
    """Number the rows of full batches in the order in which the batches fill up, by their last row's arrival.

    Adds ``shard_no``, ``shard_pos`` and ``shard_key``. Only narrow rows, one per batch, are ordered.
    """
    last = batches.filter(F.col("slot") == batch_size - 1).select("bucket", "batch_no", "shard_idx", "pos")
    numbered = with_ordinal(last, ["shard_idx", "pos"], name="__batch", block_rows=tar.BLOCK_UNITS)
    joined = batches.join(numbered.select("bucket", "batch_no", "__batch"), ["bucket", "batch_no"])
    place = F.col("__batch") * F.lit(batch_size) + F.col("slot")
    dealt = joined.withColumns({"shard_no": F.floor(place / F.lit(shard_size)), "shard_pos": F.pmod(place, F.lit(shard_size))})
    return dealt.withColumn("shard_key", fields.rekey(F.col("shard_pos"), 7)).drop("__batch")


def by_feature_shard(dealt: DataFrame, tasks: int) -> DataFrame:
    """Narrow rows in the task that will write their feature shard, sorted so that a batch lies together."""
    return dealt.repartition(tasks, "shard_no").sortWithinPartitions("bucket", "shard_no", "shard_pos")


def precompute_features(
    spark: SparkSession,
    paths: str | list[str],
    out: str,
    bins: Bins,
    image_factory: Callable[[], features.Encoder],
    text_factory: Callable[[], features.Encoder],
    batch_size: int,
    shard_size: int,
    latent_type: str = "array<float>",
    emb_type: str = "array<array<float>>",
    caption: Callable[[Column], Column] | None = None,
    emission_order: bool = False,
    cache_path: str | None = None,
) -> int | None:
    """Encode full batches and write ``shard_no, key, ratio, latent, emb, _error`` as Parquet.

    Features are numbered as their samples arrive, or with ``emission_order`` as their batches fill up. Then narrow rows are dealt to tasks by feature
    shard before the members are fetched, and the task that encodes a shard writes it: encoded rows aren't shuffled. With a
    ``cache_path`` only samples that this ``FeatureCache`` lacks are encoded, and their number is returned. Readers take the rows of ``features.valid_features``; the others count as missing.
    """
    index = image_index(spark, paths, nearest(bins, limit=100.0, fallback=0.6))
    batches = batching.bucket_batches(index, batch_size, block_rows=tar.BLOCK_UNITS)
    if emission_order:
        dealt = in_emission_order(batches, batch_size, shard_size)
    else:
        dealt = sharding.shard_numbering(batches, shard_size, digits=7, block_rows=tar.BLOCK_UNITS)

    def encoded(narrow: DataFrame, arrange: bool = True) -> DataFrame:
        return encode_batches(
            narrow,
            image_factory,
            text_factory,
            batch_size,
            batch_size,
            latent_type,
            emb_type,
            tasks=tar.fetch_tasks(index),
            caption=caption,
            arrange=arrange,
        )

    if cache_path:
        dealt = written(keyed(dealt), "dealt")
        schema = f"sample string, latent {latent_type}, emb {emb_type}, _error string"
        cache = FeatureCache(spark, cache_path, schema, ["sample"])
        fresh = cache.refresh(dealt, encoded)
        named = dealt.select("sample", "shard_no", "shard_pos", F.col("shard_key").alias("key"), F.col("bucket").alias("ratio"))
        # Samples that could not be encoded are in the cache with their error and are tried again by the next run.
        kept = cache.read().groupBy("sample").agg(F.max_by(F.struct("latent", "emb", "_error"), F.col("_error").isNull()).alias("f"))
        features.write_features(named.join(kept, "sample").select("shard_no", "shard_pos", "key", "ratio", "f.*"), out)
        return fresh
    if emission_order:
        rows = encoded(by_feature_shard(dealt, tar.fetch_tasks(index)), arrange=False)
        rows = rows.select("shard_no", "shard_pos", F.col("shard_key").alias("key"), F.col("bucket").alias("ratio"), "latent", "emb", "_error")
        rows.write.partitionBy("ratio").parquet(out)
        return None
    rows = encoded(dealt)
    features.write_features(
        rows.select(
            "shard_no", "shard_pos", F.col("shard_key").alias("key"), F.col("bucket").alias("ratio"), "latent", "emb", "_error"
        ),
        out,
    )
    return None
