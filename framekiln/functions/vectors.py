"""Array columns: padding, masks, affine maps, layout and pooling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pad(x: Column, length: int, zero: Column, on_long: str = "crop") -> Column:
    """Pad an array with ``zero`` to ``length``; a longer one is cropped or an error."""
    if on_long not in ("crop", "error"):
        raise ValueError("on_long is 'crop' or 'error'")
    padded = F.slice(F.concat(x, F.array_repeat(zero, F.greatest(F.lit(length) - F.size(x), F.lit(0)))), 1, length)
    if on_long == "crop":
        return padded
    message = F.concat(F.lit("sequence of "), F.size(x).cast("string"), F.lit(f" tokens is longer than {length}"))
    return F.when(F.size(x) > length, F.raise_error(message)).otherwise(padded)


def zero_token(dim: int) -> Column:
    """A token vector of zeros."""
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def mask(x: Column, length: int) -> Column:
    """1 for each real token and 0 for each padded one."""
    real = F.least(F.size(x), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.lit(length) - real))


def mask_trim(x: Column, token_mask: Column) -> Column:
    """Only the tokens whose mask is set."""
    return F.filter(x, lambda v, i: F.get(token_mask, i) == 1)


def head_tail(x: Column, length: int) -> Column:
    """The first element and the last ``length - 1``."""
    tail = length - 1
    return F.concat(F.slice(x, 1, 1), F.slice(x, F.greatest(F.size(x) - tail, F.lit(0)) + 1, tail))


def scale(x: Column, factor: float) -> Column:
    """``x * factor``"""
    return F.transform(x, lambda v: v * F.lit(factor))


def shift_scale(x: Column, shift: float, factor: float) -> Column:
    """``(x - shift) * factor``"""
    return F.transform(x, lambda v: (v - F.lit(shift)) * F.lit(factor))


def standardise(x: Column, mean: Column, variance: Column, eps: float) -> Column:
    """``(x - mean) / sqrt(variance + eps)``, element by element."""
    centred = F.zip_with(x, mean, lambda v, m: v - m)
    return F.zip_with(centred, variance, lambda v, s: v / F.sqrt(s + F.lit(eps)))


def channel_standardise(x: Column, per_channel: int, mean: Sequence[float], std: Sequence[float]) -> Column:
    """``(x - mean) / std`` on a channel-first array of ``per_channel`` values per channel."""
    means = F.array(*[F.lit(float(m)) for m in mean])
    stds = F.array(*[F.lit(float(s)) for s in std])

    def one(v: Column, i: Column) -> Column:
        channel = F.floor(i / F.lit(per_channel)).cast("int")
        return (v - F.get(means, channel)) / F.get(stds, channel)

    return F.transform(x, one)


def pixel_normalise(x: Column) -> Column:
    """From 0..255 to -1..1."""
    return F.transform(x, lambda v: (v / F.lit(255.0) - F.lit(0.5)) / F.lit(0.5))


def pixel_unit(x: Column) -> Column:
    """From -1..1 to 0..1."""
    return F.transform(x, lambda v: (v + F.lit(1.0)) / F.lit(2.0))


def hwc_to_chw(x: Column, height: Column, width: Column, channels: int) -> Column:
    """Reorder a flat height x width x channel array to channel first."""
    area = height * width
    places = F.sequence(F.lit(0), area * F.lit(channels) - 1)
    picked = F.transform(
        places, lambda i: F.get(x, (F.pmod(i, area) * F.lit(channels) + F.floor(i / area)).cast("int"))
    )
    return F.when(area > 0, picked).otherwise(F.slice(x, 1, 0))


def mean_tokens(tokens: Column, dim: int) -> Column:
    """The mean vector of an array of token vectors, inside the row."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(tokens, zeros, lambda acc, t: F.zip_with(acc, t, lambda a, b: a + b))
    return F.when(F.size(tokens) > 0, F.transform(total, lambda v: v / F.size(tokens)))


def mean_pool(df: DataFrame, group: Sequence[str], vector: str = "embedding", out: str = "pooled") -> DataFrame:
    """Mean vector per group of rows.

    The vectors are summed on the map side, so a hot group shuffles one vector per
    task instead of one row per token and dimension.
    """
    pooled = Summarizer.mean(array_to_vector(F.col(vector)))
    return df.groupBy(*group).agg(vector_to_array(pooled).alias(out))


def mse(a: Column, b: Column) -> Column:
    """Mean squared difference of two arrays."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v) / F.size(a)


def alignment_error(
    pooled: DataFrame, targets: DataFrame, key: str, module: str = "module", vector: str = "pooled", target: str = "target"
) -> DataFrame:
    """Mean squared error of each module's pooled vectors against their targets."""
    pairs = pooled.join(targets, key)
    return pairs.groupBy(module).agg(F.avg(mse(F.col(vector), F.col(target))).alias("error"))


def mean_alignment(errors: DataFrame) -> DataFrame:
    """The alignment loss: the mean over modules."""
    return errors.agg(F.avg("error").alias("loss"))
