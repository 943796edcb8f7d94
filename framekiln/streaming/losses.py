"""Training losses as they arrive from the ranks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_loss(log: DataFrame, ranks: int, accumulation: int) -> DataFrame:
    """The loss per step so far, for sinks that take updates: ``step, loss, rows``."""
    step = F.floor(F.col("micro") / F.lit(accumulation)).alias("step")
    return log.groupBy(step).agg(
        (F.sum("loss") / F.lit(ranks)).alias("loss"), F.count(F.lit(1)).alias("rows")
    )


def step_losses(log: DataFrame, ranks: int, accumulation: int, block: int = 256) -> DataFrame:
    """``step, loss`` once all micro-steps of all ranks have arrived, for append-only sinks."""
    needed = ranks * accumulation
    return step_updates(log, ranks, accumulation, block).filter(F.col("rows") >= needed).select("step", "loss")


def step_updates(log: DataFrame, ranks: int, accumulation: int, block: int = 256) -> DataFrame:
    """``step, loss, rows`` so far of each step that a micro-batch adds to, for sinks that merge by step.

    Spark lets no Python sink take update mode, so changed rows are appended. A state key is a block of consecutive steps, so that one call handles many. It
    holds a sum and a count for each step that is not complete.
    """
    needed = ranks * accumulation

    def add(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [part.groupby("step")["loss"].agg(total="sum", rows="count") for part in parts]
        fresh = set().union(*(part.index for part in held))
        if state.exists:
            steps, totals, rows = state.get
            held.append(pd.DataFrame({"total": totals, "rows": rows}, index=pd.Index(steps, name="step")))
        sums = pd.concat(held).groupby(level="step").sum()
        whole = sums["rows"] >= needed
        rest = sums[~whole]
        if len(rest):
            state.update((rest.index.tolist(), rest["total"].tolist(), rest["rows"].tolist()))
        elif state.exists:
            state.remove()
        changed = sums[sums.index.isin(fresh)]
        yield pd.DataFrame({"step": changed.index, "loss": changed["total"].to_numpy() / ranks, "rows": changed["rows"].to_numpy()})

    steps = log.withColumn("step", F.floor(F.col("micro") / F.lit(accumulation)))
    return (
        steps.withColumn("__block", F.floor(F.col("step") / F.lit(block)))
        .groupBy("__block")
        .applyInPandasWithState(
            add,
            "step bigint, loss double, rows bigint",
            "steps array<bigint>, totals array<double>, rows array<bigint>",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )
