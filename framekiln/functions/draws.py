"""Seeded draws: every random choice is a pure function of a seed and a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(seed, keys) -> Column:
    columns = [k if isinstance(k, Column) else F.col(k) for k in keys]
    first = seed if isinstance(seed, Column) else F.lit(seed)
    return F.concat_ws("|", *[c.cast("string") for c in (first, *columns)])


def draw_hex(seed, *keys) -> Column:
    """32 hex digits: a sort key for a seeded shuffle."""
    return F.md5(_parts(seed, keys))


def draw_int(seed, *keys) -> Column:
    """A uniform integer in [0, 2^32)."""
    return F.conv(F.substring(draw_hex(seed, *keys), 1, 8), 16, 10).cast("long")


def draw_unit(seed, *keys) -> Column:
    """A uniform double in [0, 1)."""
    return draw_int(seed, *keys) / F.lit(4294967296.0)


def draw_below(n, seed, *keys) -> Column:
    """A uniform integer in [0, n)."""
    bound = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(draw_int(seed, *keys), bound)


def hex_block(name: str, digits: int = 4) -> Column:
    """Leading digits of a hex draw: even blocks of the shuffled order."""
    return F.substring(F.col(name), 1, digits)
