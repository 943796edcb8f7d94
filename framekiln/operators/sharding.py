"""Splitting rows into shards and shards over ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framekiln.functions.fields import rekey
from framekiln.operators.numbering import BLOCK_ROWS, with_ordinal

ARRIVAL = ("shard_idx", "pos")


def shard_name(number: Column, folder: str | None = None) -> Column:
    """``shard-000012.tar``, optionally under a folder."""
    prefix = f"{folder.rstrip('/')}/" if folder else ""
    return F.format_string(f"{prefix}shard-%06d.tar", number)


def shard_names(df: DataFrame, number: str = "shard_no", folder: str | None = None) -> DataFrame:
    """Add the file name of each row's shard."""
    return df.withColumn("shard", shard_name(F.col(number), folder))


def shard_range(spark, begin: int, end: int, folder: str | None = None) -> DataFrame:
    """Shard names ``begin`` to ``end - 1``."""
    return shard_names(spark.range(begin, end).withColumnRenamed("id", "shard_no"), folder=folder)


def shard_numbering(
    df: DataFrame,
    shard_size: int,
    order: Sequence[str] = ARRIVAL,
    digits: int = 6,
    drop_tail: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Deal rows in order into shards of ``shard_size``; the counter restarts per shard.

    Adds ``shard_no``, ``shard_pos`` and the zero-padded ``shard_key`` (6 digits for
    image shards, 7 for feature shards). The last, shorter shard is kept unless
    ``drop_tail`` is set.
    """
    numbered = with_ordinal(df, order, name="__at", total="__total", block_rows=block_rows)
    dealt = numbered.withColumns(
        {
            "shard_no": F.floor(F.col("__at") / F.lit(shard_size)),
            "shard_pos": F.pmod(F.col("__at"), F.lit(shard_size)),
        }
    )
    if drop_tail:
        dealt = dealt.filter(F.col("shard_no") < F.floor(F.col("__total") / F.lit(shard_size)))
    return dealt.withColumn("shard_key", rekey(F.col("shard_pos"), digits)).drop("__at", "__total")


def readers(number: Column, shards: int | Column, ranks: int, when_few: str = "all") -> Column:
    """The ranks that read a shard, as an array; see ``rank_ranges``."""
    if when_few not in ("all", "last"):
        raise ValueError("when_few is 'all' or 'last'")
    count = shards if isinstance(shards, Column) else F.lit(shards)
    each = F.floor(count / F.lit(ranks))
    own = F.least(F.floor(F.try_divide(number, each)).cast("int"), F.lit(ranks - 1))
    few = F.sequence(F.lit(0 if when_few == "all" else ranks - 1), F.lit(ranks - 1))
    return F.when(each == 0, few).otherwise(F.array(own))


def rank_ranges(shards: DataFrame, ranks: int, number: str = "shard_no", when_few: str = "all") -> DataFrame:
    """Give each rank a contiguous range of the numbered shards; adds ``rank``.

    Each rank gets ``n // ranks`` shards and the last one also the remainder. With
    fewer shards than ranks, ``when_few`` says who reads: ``all`` ranks read every
    shard (training), or only the ``last`` rank does (feature extraction).
    ``number`` counts the shards from 0 without gaps, as ``shard_numbering`` does.
    """
    count = shards.agg(F.count(F.lit(1))).scalar()
    return shards.withColumn("rank", F.explode(readers(F.col(number), count, ranks, when_few)))


def every_rank(shards: DataFrame, ranks: int) -> DataFrame:
    """Subject training: every rank reads every shard."""
    return shards.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))


def rank_round_robin(
    df: DataFrame, ranks: int, order: Sequence[str] = ARRIVAL, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Row i of the whole order belongs to rank ``i % ranks``; adds ``row_idx`` and ``rank``."""
    numbered = with_ordinal(df, order, name="row_idx", block_rows=block_rows)
    return numbered.withColumn("rank", F.pmod("row_idx", F.lit(ranks)).cast("int"))


def strided_index(
    df: DataFrame, ranks: int, rank: str = "rank", order: Sequence[str] = ARRIVAL, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Output number ``rank + k * ranks`` for the k-th row of a rank; adds ``out_idx``."""
    numbered = with_ordinal(df, order, [rank], name="__k", block_rows=block_rows)
    return numbered.withColumn("out_idx", F.col(rank) + F.col("__k") * F.lit(ranks)).drop("__k")
