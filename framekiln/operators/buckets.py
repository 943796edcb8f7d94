"""Aspect-ratio buckets: the bin table, nearest-bin joins and bucket counts."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bins:
    """An ordered table of (ratio, height, width)."""

    rows: tuple[tuple[float, int, int], ...]

    def __post_init__(self):
        if not self.rows:
            raise ValueError("a bin table has one row at least")

    @classmethod
    def from_mapping(cls, table: Mapping[str, Sequence[float]]) -> "Bins":
        """From ``{"0.25": [512, 2048], ...}``, in the mapping's order."""
        return cls(tuple((float(r), int(hw[0]), int(hw[1])) for r, hw in table.items()))

    @classmethod
    def from_sizes(cls, sizes: Iterable[tuple[int, int]]) -> "Bins":
        return cls(tuple((h / w, h, w) for h, w in sizes))

    @property
    def ratios(self) -> list[float]:
        return [r for r, _, _ in self.rows]

    def pick(self, ordinal: str, what: str) -> Column:
        """Look up ``ratio``, ``height`` or ``width`` by the 0-based bin number in a column."""
        at = ("ratio", "height", "width").index(what)
        values = [_double(row[0]) if what == "ratio" else str(row[at]) for row in self.rows]
        return F.expr(f"get(array({', '.join(values)}), `{ordinal}`)")


def _double(value: float) -> str:
    return f"{float(value)!r}D"


def aspect_ratio(height: Column, width: Column) -> Column:
    """height / width; null when the width is 0 or unknown."""
    return F.try_divide(height.cast("double"), width.cast("double"))


def _cuts(candidates: Sequence[float]) -> tuple[list[int], list[float]]:
    """Candidate numbers in rising order, and the least ratio at which each but the first is nearest.

    Between two neighbours the preference changes once, so the exact double at which
    it does is found by bisection. Of equal candidates only the first counts.
    """
    order = sorted({c: i for i, c in reversed(list(enumerate(candidates)))}.values(), key=lambda i: candidates[i])
    cuts = []
    for i, j in zip(order, order[1:]):
        low, high = candidates[i], candidates[j]
        below, above = low, high
        while math.nextafter(below, math.inf) < above:
            middle = below + (above - below) / 2
            to_low, to_high = middle - low, high - middle
            if to_high < to_low or (to_high == to_low and j < i):
                above = middle
            else:
                below = middle
        cuts.append(above)
    return order, cuts


def _search(ratio: str, cuts: Sequence[float], order: Sequence[int]) -> str:
    """Binary search as nested conditions: as deep as the logarithm of the number of bins."""
    if not cuts:
        return str(order[0])
    middle = len(cuts) // 2
    below = _search(ratio, cuts[:middle], order[: middle + 1])
    above = _search(ratio, cuts[middle + 1 :], order[middle + 1 :])
    return f"IF(`{ratio}` < {_double(cuts[middle])}, {below}, {above})"


def _first_nearest(df: DataFrame, ratio: str, candidates: Sequence[float], out: str, limit: float) -> DataFrame:
    # Comparisons with constants: generated code without join or lambda. A row whose nearest
    # candidate is not closer than the limit has none.
    values = [float(c) for c in candidates]
    order, cuts = _cuts(values)
    found = df.withColumn(out, F.expr(_search(ratio, cuts, order)))
    nearest = f"get(array({', '.join(map(_double, values))}), `{out}`)"
    close = F.expr(f"IF(`{ratio}` < {nearest}, {nearest} - `{ratio}`, `{ratio}` - {nearest}) < {_double(limit)}")
    return found.withColumn(out, F.when(close, F.col(out)))


def nearest_bin(
    df: DataFrame,
    bins: Bins,
    ratio: str = "ratio",
    out: str = "bucket",
    limit: float = 1000.0,
    fallback: float = -1.0,
    sizes: bool = False,
) -> DataFrame:
    """Add the ratio of the bin nearest to ``ratio``; the first bin wins a tie.

    Rows with no bin closer than ``limit`` get ``fallback``. The two rules in use are
    (1000, -1) for training batches and (100, 0.6) for precomputed features. With
    ``sizes`` the bin's ``target_height`` and ``target_width`` come along, those of the
    fallback if that is a bin's ratio.
    """
    found = _first_nearest(df, ratio, bins.ratios, "__bin", limit)
    if float(fallback) in bins.ratios:
        found = found.withColumn("__bin", F.coalesce("__bin", F.lit(bins.ratios.index(float(fallback)))))
    added = {out: F.coalesce(bins.pick("__bin", "ratio"), F.lit(float(fallback)))}
    if sizes:
        added["target_height"] = bins.pick("__bin", "height")
        added["target_width"] = bins.pick("__bin", "width")
    return found.withColumns(added).drop("__bin")


def target_size(df: DataFrame, bins: Bins, bucket: str = "bucket") -> DataFrame:
    """Add the image size of a row's bin, by exact bin ratio."""
    cases = " ".join(f"WHEN `{bucket}` = {_double(r)} THEN {i}" for i, r in enumerate(bins.ratios))
    found = df.withColumn("__bin", F.expr(f"CASE {cases} END"))
    sizes = {"target_height": bins.pick("__bin", "height"), "target_width": bins.pick("__bin", "width")}
    return found.withColumns(sizes).drop("__bin")


def nearest_open_bucket(
    df: DataFrame, open_buckets: DataFrame, ratio: str = "ratio", out: str = "bucket", bucket: str = "bucket"
) -> DataFrame:
    """As ``nearest_bin``, over the buckets that occur in ``open_buckets``.

    A ratio of -1 marks an invalid row and stays -1. Buckets come from a bin table, so
    the values that are read to the driver are as many as its rows at most. Buckets are
    tried in rising order.
    """
    seen = [r[0] for r in open_buckets.select(bucket).distinct().collect()]
    if not seen:
        return df.withColumn(out, F.lit(-1.0))
    seen.sort()
    found = _first_nearest(df, ratio, seen, "__at", 1000.0)
    nearest = F.coalesce(F.expr(f"get(array({', '.join(map(_double, seen))}), __at)"), F.lit(-1.0))
    return found.withColumn(out, F.when(F.col(ratio) == -1.0, F.lit(-1.0)).otherwise(nearest)).drop("__at")


def nearest_in_class(
    df: DataFrame, bins_by_class: Mapping[object, Sequence[float]], class_col: str, ratio: str = "ratio", out: str = "bucket"
) -> DataFrame:
    """Nearest candidate among those of the row's own class; -1 for a class without any.

    ``bins_by_class`` maps a class value to its ordered ratios.
    """
    picked = F.lit(None).cast("double")
    work = df
    for i, (value, ratios) in enumerate(bins_by_class.items()):
        if not ratios:
            continue
        work = _first_nearest(work, ratio, ratios, f"__at{i}", 1000.0)
        here = F.expr(f"get(array({', '.join(map(_double, ratios))}), __at{i})")
        picked = F.when(F.col(class_col) == F.lit(value), here).otherwise(picked)
    return work.withColumn(out, F.coalesce(picked, F.lit(-1.0))).drop(
        *[f"__at{i}" for i in range(len(bins_by_class))]
    )


def ratio_counts(df: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Rows per bucket, without the invalid marker -1."""
    return df.filter(F.col(bucket) != -1.0).groupBy(bucket).agg(F.count(F.lit(1)).alias("rows"))


def pair_counts(df: DataFrame, class_col: str = "is_reg", bucket: str = "bucket") -> DataFrame:
    """Rows per (class, bucket), without the invalid marker -1."""
    return df.filter(F.col(bucket) != -1.0).groupBy(class_col, bucket).agg(F.count(F.lit(1)).alias("rows"))


def bucket_readiness(df: DataFrame, ranks: int, batch_size: int, bucket: str = "bucket", rank: str = "rank") -> DataFrame:
    """Per bucket the smallest row count over all ranks, and whether it fills a batch.

    A rank without rows in a bucket counts as 0.
    """
    per_rank = df.groupBy(bucket, rank).agg(F.count(F.lit(1)).alias("rows"))
    least = F.when(F.count(F.lit(1)) == ranks, F.min("rows")).otherwise(F.lit(0))
    return per_rank.groupBy(bucket).agg(least.alias("min_rows")).withColumn("ready", F.col("min_rows") >= batch_size)
