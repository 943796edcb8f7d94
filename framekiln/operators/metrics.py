"""Roll-ups of training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def loss_rollup(
    log: DataFrame, accumulation: int, rank: str = "rank", micro: str = "micro", loss: str = "loss"
) -> DataFrame:
    """Loss per step: summed over a rank's micro-steps, then averaged over ranks.

    ``loss`` is the logged figure; ``mean_loss`` divides it by the micro-steps.
    """
    step = F.floor(F.col(micro) / F.lit(accumulation)).alias("step")
    per_rank = log.groupBy(step, F.col(rank)).agg(F.sum(loss).alias("__sum"), F.count(loss).alias("__n"))
    return per_rank.groupBy("step").agg(
        F.avg("__sum").alias("loss"), F.avg(F.col("__sum") / F.col("__n")).alias("mean_loss")
    )


def best_of_n(
    trials: DataFrame, step: str = "step", trial: str = "trial", loss: str = "loss", state: str = "state"
) -> DataFrame:
    """The random state with the lowest loss per step; the earliest trial wins a tie."""
    least = F.struct(F.col(loss), F.col(trial))
    return trials.groupBy(step).agg(
        F.min_by(state, least).alias(state), F.min_by(trial, least).alias(trial), F.min(loss).alias(loss)
    )


def append_log(log: DataFrame, path: str) -> None:
    """Append logged scalars to the Parquet training log."""
    log.write.mode("append").parquet(path)
