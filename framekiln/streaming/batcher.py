"""Batching of an endless sample stream with state per bucket.

A state key is one bucket of one rank. Every rank fills its own batches, so a hot
bucket is spread over as many state keys as there are ranks. Within a micro-batch
rows are taken in arrival order; the trigger's file limit bounds what a key holds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

ARRIVAL = ("shard_idx", "pos")


def _state_schema(df: DataFrame, columns: Sequence[str]) -> StructType:
    kept = [StructField(c, ArrayType(df.schema[c].dataType)) for c in columns]
    return StructType([StructField("__batches", LongType()), *kept])


def _arrived(parts: Iterator[pd.DataFrame], columns: Sequence[str], order: Sequence[str]) -> pd.DataFrame:
    rows = pd.concat(list(parts), ignore_index=True)
    return rows.sort_values(list(order), kind="stable")[list(columns)]


def _held(state: GroupState, columns: Sequence[str]) -> tuple[int, pd.DataFrame]:
    if not state.exists:
        return 0, pd.DataFrame({c: [] for c in columns}, dtype=object)
    batches, *arrays = state.get
    return batches, pd.DataFrame({c: pd.Series(list(a), dtype=object) for c, a in zip(columns, arrays)})


def _keep(state: GroupState, batches: int, rows: pd.DataFrame) -> None:
    state.update((batches, *[rows[c].tolist() for c in rows.columns]))


def stream_bucket_batches(
    samples: DataFrame,
    batch_size: int,
    bucket: str = "bucket",
    rank: str = "rank",
    order: Sequence[str] = ARRIVAL,
) -> DataFrame:
    """Emit a batch as soon as a rank has ``batch_size`` rows of a bucket.

    Adds ``batch_no`` and ``slot``. Fewer than ``batch_size`` rows stay in the state
    of each key.
    """
    columns = [c for c in samples.columns if c not in (rank, bucket)]
    keys = StructType([samples.schema[rank], samples.schema[bucket]])
    numbers = [StructField("batch_no", LongType()), StructField("slot", IntegerType())]
    output = StructType([*keys, *numbers, *[samples.schema[c] for c in columns]])

    def fill(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, held = _held(state, columns)
        arrived = _arrived(parts, columns, order).astype(object)
        rows = pd.concat([held, arrived], ignore_index=True) if len(held) else arrived.reset_index(drop=True)
        whole = len(rows) // batch_size
        _keep(state, done + whole, rows.iloc[whole * batch_size :])
        full = rows.iloc[: whole * batch_size].copy()
        at = full.index.to_numpy()
        full.insert(0, "slot", (at % batch_size).astype("int32"))
        full.insert(0, "batch_no", done + at // batch_size)
        full.insert(0, bucket, key[1])
        full.insert(0, rank, key[0])
        yield full

    return samples.groupBy(rank, bucket).applyInPandasWithState(
        fill, output, _state_schema(samples, columns), "append", GroupStateTimeout.NoTimeout
    )


def stream_bounded_batches(
    samples: DataFrame,
    ranks: int,
    batch_size: int,
    bucket: str = "bucket",
    rank: str = "rank",
    order: Sequence[str] = ARRIVAL,
) -> DataFrame:
    """Batches in step over ranks, with bounded state.

    Rows that agree in ``order`` arrive in one step. A bucket keeps the newest ``batch_size``
    rows of each rank; older ones drop out while other ranks lag behind. After every step a bucket
    that is full on all ranks is emitted and emptied, so the batches depend on the order of
    rows and not on how many of them a micro-batch holds; the rows of a step have to come in one
    micro-batch, and steps in order. Adds ``batch_no`` and ``slot``.

    The rule needs all ranks of a bucket at once. Keep rows narrow (positions), and join
    or fetch what else is wanted by position afterwards.
    """
    columns = [c for c in samples.columns if c != bucket]
    numbers = [StructField("batch_no", LongType()), StructField("slot", IntegerType())]
    output = StructType([samples.schema[bucket], *numbers, *[samples.schema[c] for c in columns]])

    def fill(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, held = _held(state, columns)
        arrived = _arrived(parts, columns, order).astype(object)
        rows = (pd.concat([held, arrived], ignore_index=True) if len(held) else arrived).reset_index(drop=True)
        owners, steps = rows[rank].tolist(), list(zip(*(rows[c].tolist() for c in order)))
        newest: dict = {}
        full, taken, batches = 0, [], []
        for i, owner in enumerate(owners):
            own = newest.setdefault(owner, deque(maxlen=batch_size))
            full += len(own) == batch_size - 1
            own.append(i)
            step_over = i + 1 == len(steps) or steps[i + 1] != steps[i]
            if i >= len(held) and step_over and full == ranks:
                for r in sorted(newest):
                    taken += newest[r]
                batches.append(done)
                newest, full, done = {}, 0, done + 1
        _keep(state, done, rows.iloc[sorted(i for own in newest.values() for i in own)])
        out = rows.iloc[taken].copy()
        size = ranks * batch_size
        out.insert(0, "slot", (np.arange(len(out)) % batch_size).astype("int32"))
        out.insert(0, "batch_no", np.repeat(batches, size).astype("int64"))
        out.insert(0, bucket, key[0])
        yield out

    return samples.groupBy(bucket).applyInPandasWithState(
        fill, output, _state_schema(samples, columns), "append", GroupStateTimeout.NoTimeout
    )
