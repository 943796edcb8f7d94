"""Sample fields: picking, checking and naming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE_EXTENSIONS = ("jpg", "jpeg", "png")


def field(fields: Column, ext: str) -> Column:
    """A member's bytes by extension; null when the sample has none."""
    return F.try_element_at(fields, F.lit(ext))


def text_field(fields: Column, ext: str = "txt") -> Column:
    """A member as UTF-8 text; null when it is none or there is no such member."""
    return F.try_validate_utf8(field(fields, ext).cast("string"))


def first_present(fields: Column, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> Column:
    """The first of several members that the sample has."""
    return F.coalesce(*[field(fields, ext) for ext in extensions])


def first_extension(fields: Column, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> Column:
    """The extension that ``first_present`` picks."""
    return F.coalesce(*[F.when(field(fields, ext).isNotNull(), F.lit(ext)) for ext in extensions])


def project_fields(df: DataFrame, columns: Sequence[str] = ("image", "caption")) -> DataFrame:
    """Only the fields that training reads; the scan reads no others."""
    return df.select(*columns)


def required_fields(df: DataFrame, columns: Sequence[str] = ("image", "caption")) -> DataFrame:
    """Drop samples that lack any of the fields."""
    return df.dropna(subset=list(columns))


def rekey(position: Column, digits: int = 6) -> Column:
    """A zero-padded sample key."""
    return F.format_string(f"%0{digits}d", position)


def patch_grid(height: Column, width: Column, patch: int = 16) -> Column:
    """Patches per side, as ``struct<grid_h, grid_w>``."""
    return F.struct(
        F.floor(height / F.lit(patch)).cast("int").alias("grid_h"),
        F.floor(width / F.lit(patch)).cast("int").alias("grid_w"),
    )


# Fixed value: side of the token grid of the vision branch.
VISION_GRID = 16


def size_condition(bin_height: Column, bin_width: Column, latent_height: Column, latent_width: Column) -> Column:
    """``[original h, w, crop 0, 0, target h, w]``; the original size is the bin's."""
    return F.array(bin_height, bin_width, F.lit(0), F.lit(0), latent_height, latent_width)


def caption_default(caption: Column, is_reg: Column, instance_word: str, class_word: str) -> Column:
    """The caption; without one, the class word, led by the instance word for subjects."""
    own = F.lit(f"{instance_word} {class_word}")
    return F.coalesce(caption, F.when(is_reg, F.lit(class_word)).otherwise(own))
