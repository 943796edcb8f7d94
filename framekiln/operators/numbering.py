"""Gap-free row numbers in a total order, without one big window.

A window over a whole bucket (or over the whole table) puts a third of the data
in one task when one bucket is hot. Here the order is cut into blocks that follow
from the data alone, so every pass and every task retry cuts it the same way:

1. count rows per (group, block), with map-side combine; this small table is written once;
2. running sum of those counts: one row per block, not per row;
3. ``row_number`` inside each (group, block), plus the block's offset.

Rows are shuffled once, on (group, block), and no window partition holds more
than one block of one group.

Positions may be sparse (times, say), and then blocks are as many as rows. So step 2 has two levels (``prefixes``):
beyond ``LEVEL_ROWS`` blocks, the sorted table of blocks is cut into ranges by the measured rows, each range is summed up by itself, and
one row per range and group gives what lies before it. No window holds more than ``LEVEL_ROWS`` blocks or, above, one row per range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65536
# Blocks in one range of the table of blocks, and so in one window.
LEVEL_ROWS = 1 << 20


def prefixes(
    blocks: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: str,
    how: Callable[[str], Column] = F.sum,
    name: str = "__offset",
    total: str | None = None,
    level_rows: int = LEVEL_ROWS,
) -> DataFrame:
    """Add the sum (or maximum) of ``value`` over the blocks before each one in its group, null for the first, and
    over the whole group as ``total``.

    ``blocks`` is a small table with one row per block; it is written, so that its ranges stay as they are.
    """
    from framekiln.session import written

    fixed = written(blocks, "blocks")
    ranges = -(-fixed.count() // level_rows)
    if ranges <= 1:
        own = Window.partitionBy(*group)
        before = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        whole = [how(value).over(own).alias(total)] if total else []
        return fixed.select(*fixed.columns, how(value).over(before).alias(name), *whole)
    # Twice as many ranges as needed, as their bounds come from a sample.
    spread = fixed.repartitionByRange(2 * ranges, *group, *order)
    spread = written(spread.withColumn("__range", F.spark_partition_id()), "block-ranges")
    keys = [*group, "__range"]
    above = spread.groupBy(*keys).agg(how(value).alias("__in"))
    own = Window.partitionBy(*group)
    before = own.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = [how("__in").over(own).alias(total)] if total else []
    above = above.select(*keys, how("__in").over(before).alias("__above"), *whole)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = spread.withColumn("__inside", how(value).over(inside)).join(above, keys)
    # The same function puts the two levels together; it ignores nulls.
    parts = F.array_compact(F.array("__above", "__inside"))
    zero = F.lit(0).cast(blocks.schema[value].dataType)
    both = F.array_max(parts) if how is F.max else F.when(F.size(parts) > 0, F.aggregate(parts, zero.cast("long"), lambda a, v: a + v))
    return joined.select(*blocks.columns, both.alias(name), *([total] if total else []))


def with_ordinal(
    df: DataFrame,
    order: Sequence[str],
    group: Sequence[str] = (),
    name: str = "ordinal",
    total: str | None = None,
    blocks: Sequence[Column] | None = None,
    block_rows: int = BLOCK_ROWS,
    level_rows: int = LEVEL_ROWS,
    extend: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its group, and the group's size.

    ``order`` must be a total order in the group; neither it nor ``group`` may hold
    nulls, as every bucket, rank and position is known here. By default its last
    column is an integer position that is cut into blocks of ``block_rows`` values,
    while the columns before it are whole block keys. ``blocks`` replaces that rule
    with any columns that never fall while the order rises. Choose ``block_rows`` so
    that a block of full-width rows is a fair size for one task.

    ``extend`` may add columns to the table of blocks (group columns and ``total``);
    they reach the rows through the same join.
    """
    if blocks is None:
        blocks = [F.col(c) for c in order[:-1]]
        blocks.append(F.floor(F.col(order[-1]) / F.lit(block_rows)))
    block_names = [f"__block{i}" for i in range(len(blocks))]
    keys = [*group, *block_names]
    cut = df.withColumns(dict(zip(block_names, blocks)))

    counts = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    summed = prefixes(counts, group, block_names, "__rows", total=total, level_rows=level_rows)
    offsets = summed.select(*keys, F.coalesce("__offset", F.lit(0)).alias("__offset"), *([total] if total else []))
    known = set(offsets.columns)
    if extend:
        offsets = extend(offsets)
    added = [c for c in offsets.columns if c not in known]
    inside = Window.partitionBy(*keys).orderBy(*order)
    numbered = cut.withColumn("__inside", F.row_number().over(inside) - 1)
    return (
        numbered.join(offsets, keys)
        .withColumn(name, F.col("__offset") + F.col("__inside"))
        .drop("__inside", "__offset", *block_names)
        .select(*df.columns, name, *([total] if total else []), *added)
    )


def with_sorted_ordinal(df: DataFrame, order: Sequence[str | Column], name: str = "ordinal") -> DataFrame:
    """Row numbers for an order that has no integer column, such as file names.

    The range-sorted rows are checkpointed with their partition, because a second
    evaluation could sample other range bounds. Meant for narrow tables.
    """
    from framekiln.session import written

    tagged = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    fixed = written(tagged, "sorted")
    # An id holds the partition in its upper bits and the row in its lower 33 bits.
    part = F.shiftright("__id", 33)
    return with_ordinal(fixed, ["__id"], name=name, blocks=[part]).drop("__id")


def running_max(
    df: DataFrame, value: str, position: str, group: Sequence[str], name: str, block_rows: int = BLOCK_ROWS, level_rows: int = LEVEL_ROWS
) -> DataFrame:
    """Largest ``value`` up to and including each row; same blocks as ``with_ordinal``.

    ``position`` must be unique in the group.
    """
    keys = [*group, "__block"]
    cut = df.withColumn("__block", F.floor(F.col(position) / F.lit(block_rows)))
    tops = cut.groupBy(*keys).agg(F.max(value).alias("__top"))
    carried = prefixes(tops, group, ["__block"], "__top", F.max, "__carry", level_rows=level_rows).select(*keys, "__carry")
    inside = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumn("__local", F.max(value).over(inside))
        .join(carried, keys)
        .withColumn(name, F.greatest("__local", "__carry"))
        .select(*df.columns, name)
    )
