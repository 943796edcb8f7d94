"""Rolling shards over a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from framekiln.functions.fields import rekey

ARRIVAL = ("shard_idx", "pos")


def stream_reshard(
    samples: DataFrame, shard_size: int, rank: str = "rank", order: Sequence[str] = ARRIVAL, digits: int = 6
) -> DataFrame:
    """Deal arriving rows into shards of ``shard_size``, each rank into its own shards.

    Adds ``shard_no``, ``shard_pos`` and ``shard_key``. The state is one row count per
    rank, kept with the sink's checkpoint: a restart neither repeats nor skips a
    number. Write the result with ``drain(..., partition_by=[rank, "shard_no"])``.
    """
    output = StructType([*samples.schema, StructField("__at", LongType())])

    def deal(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (count,) = state.get if state.exists else (0,)
        rows = pd.concat(list(parts), ignore_index=True).sort_values(list(order), kind="stable")
        rows["__at"] = range(count, count + len(rows))
        state.update((count + len(rows),))
        yield rows

    dealt = samples.groupBy(rank).applyInPandasWithState(
        deal, output, StructType([StructField("rows", LongType())]), "append", GroupStateTimeout.NoTimeout
    )
    position = F.pmod("__at", F.lit(shard_size))
    return dealt.select(
        *samples.columns,
        F.floor(F.col("__at") / F.lit(shard_size)).alias("shard_no"),
        position.alias("shard_pos"),
        rekey(position, digits).alias("shard_key"),
    )
