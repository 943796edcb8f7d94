"""Pairing captions with images across two datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framekiln.operators.numbering import with_sorted_ordinal

# Endings of the files of a dataset.
SHARD_SUFFIXES = (".tar", ".zip", ".txt", ".jpg")


def shard_listing(files: DataFrame, path: str = "path", suffixes: Sequence[str] = SHARD_SUFFIXES) -> DataFrame:
    """Files whose name ends in one of the dataset suffixes."""
    wanted = F.lit(False)
    for suffix in suffixes:
        wanted = wanted | F.col(path).endswith(suffix)
    return files.filter(wanted)


def shard_pairing(images: DataFrame, captions: DataFrame, path: str = "path") -> DataFrame:
    """The i-th caption file goes with the i-th image file, both in name order.

    The images decide how many pairs there are; a missing caption file is null.
    """
    left = with_sorted_ordinal(images.select(F.col(path).alias("image_path")), ["image_path"], "shard_idx")
    right = with_sorted_ordinal(captions.select(F.col(path).alias("caption_path")), ["caption_path"], "shard_idx")
    return left.join(right, "shard_idx", "left").select("shard_idx", "image_path", "caption_path")


def json_fields(df: DataFrame, source: Column, fields: dict[str, str]) -> DataFrame:
    """Add JSON fields as typed columns, ``{"key": "string", ...}``."""
    parsed = F.from_json(source.cast("string"), ", ".join(f"`{n}` {t}" for n, t in fields.items()))
    return df.withColumn("__json", parsed).select(*df.columns, *[F.col("__json")[n].alias(n) for n in fields])


def last_wins(df: DataFrame, keys: Sequence[str], position: str, value: str) -> DataFrame:
    """One row per key with the value at the highest position.

    An aggregate rather than a window: a key with very many copies is reduced on the
    map side before the shuffle.
    """
    return df.groupBy(*keys).agg(F.max_by(value, position).alias(value))


def caption_join(
    images: DataFrame,
    captions: DataFrame,
    keys: Sequence[str] = ("shard_idx", "key"),
    position: str = "pos",
    caption: str = "caption",
) -> DataFrame:
    """Images with the last caption of their key inside the same shard pair.

    Images without a caption are dropped. Captions are unique per key after the
    aggregate, so no key multiplies; the join strategy is left to the optimizer.
    """
    return images.join(last_wins(captions, keys, position, caption), list(keys))
