"""Encoder plug-ins and the incremental feature cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framekiln.functions import images
from framekiln.functions.pieces import pieces

Encoder = Callable[[list], Sequence]


def encoder(factory: Callable[[], Encoder], returns: str, max_batch: int) -> Callable[..., Column]:
    """An encoder plug-in as a column function.

    ``factory`` builds the model, once per task. The model takes a list of at most
    ``max_batch`` inputs and returns as many outputs. The column function takes the
    input column and, optionally, a column whose value must be the same throughout a
    model call, such as the bucket that fixes the image size. Only these two columns
    travel to Python. Outputs leave Python in pieces (see ``pieces``).
    """

    def runs(keys: pd.Series) -> list[tuple[int, int]]:
        # Row ranges of one key each, at most max_batch long.
        values = keys.to_numpy()
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        return [
            (at, min(at + max_batch, end)) for begin, end in zip(edges, edges[1:]) for at in range(begin, end, max_batch)
        ]

    @F.pandas_udf(returns)
    def encoded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()

        def outputs(inputs: pd.Series, keys: pd.Series) -> Iterator:
            for begin, end in runs(keys) if len(keys) else []:
                part = inputs.iloc[begin:end]
                # A struct column arrives as a table; its rows become dicts.
                got = list(model(part.to_dict("records") if isinstance(part, pd.DataFrame) else list(part)))
                if len(got) != end - begin:
                    raise ValueError(f"the encoder returned {len(got)} outputs for {end - begin} inputs")
                yield from got

        for inputs, keys in batches:
            for piece in pieces(outputs(inputs, keys)):
                yield pd.Series(piece, dtype=object)

    return lambda values, same=None: encoded(values, F.lit(0) if same is None else same)


def image_model(factory: Callable[[], Encoder], decoder: Callable[[], images.Decoder] = images.default_decoder):
    """A factory for ``encoder`` whose inputs are ``struct<image, height, width>``.

    Images are decoded, stretched to the bin's size and normalised inside the encoder
    call, so pixels never leave the Python worker. The model gets a list of (channel,
    height, width) arrays. An image that can't be decoded gives null.
    """

    def build() -> Encoder:
        model, decode = factory(), decoder()

        def run(rows: list) -> list:
            inputs, out = {}, [None] * len(rows)
            for i, row in enumerate(rows):
                try:
                    inputs[i] = images.model_input(decode(row["image"]), int(row["height"]), int(row["width"]))
                except Exception:  # whatever a decoder raises on a broken body
                    continue
            if inputs:
                for i, value in zip(inputs, model(list(inputs.values())), strict=True):
                    out[i] = value
            return out

        return run

    return build


def arranged(
    batches: DataFrame,
    batch: Sequence[str] = ("bucket", "batch_no"),
    slot: str = "slot",
    tasks: int | None = None,
) -> DataFrame:
    """Rows of a batch side by side, so an encoder call sees one image size.

    Spread over batches, not over buckets: a hot bucket uses all tasks. Give ``tasks``
    where the rows are narrow and their images are fetched later.
    """
    spread = batches.repartition(tasks, *batch) if tasks else batches.repartition(*batch)
    return spread.sortWithinPartitions(*batch, slot)


def valid_features(cache: DataFrame, error: str = "_error") -> DataFrame:
    """Cache rows that can be used; rows flagged corrupt count as missing."""
    return cache.filter(F.col(error).isNull()) if error in cache.columns else cache


def cache_hits(cache: DataFrame, samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cached features of the given samples."""
    return valid_features(cache).join(samples.select(*keys), list(keys), "left_semi")


def cache_misses(cache: DataFrame, samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples without usable cached features."""
    return samples.join(valid_features(cache).select(*keys), list(keys), "left_anti")


def read_through(
    samples: DataFrame, cache: DataFrame, keys: Sequence[str], encode: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Features of all samples: cached ones as they are, the others encoded."""
    fresh = encode(cache_misses(cache, samples, keys))
    return cache_hits(cache, samples, keys).unionByName(fresh, allowMissingColumns=True)


def refresh_cache(
    spark: SparkSession,
    samples: DataFrame,
    path: str,
    schema: str,
    keys: Sequence[str],
    encode: Callable[[DataFrame], DataFrame],
    compression: str = "gzip",
) -> DataFrame:
    """Encode what the cache at ``path`` lacks, append it, and return the usable cache.

    Each row of the result belongs to one of the samples; a key is encoded once. A failed run leaves no
    committed rows, so running again is safe.
    """
    empty = spark.createDataFrame([], schema)
    try:
        cache = spark.read.schema(schema).parquet(path)
    except AnalysisException:
        cache = empty
    fresh = encode(cache_misses(cache, samples, keys).dropDuplicates(list(keys)))
    fresh.select(*empty.columns).write.mode("append").option("compression", compression).parquet(path)
    return cache_hits(spark.read.schema(schema).parquet(path), samples, keys)


def cache_scan(cache: DataFrame, cache_size: int, ranks: int, index: str = "cache_idx") -> DataFrame:
    """The first ``cache_size * ranks`` cached items in index order."""
    return cache.filter(F.col(index) < cache_size * ranks).orderBy(index)


def write_features(features: DataFrame, path: str, bucket: str = "ratio", order: Sequence[str] = ("shard_no", "shard_pos")) -> None:
    """Features as Parquet, one folder per bucket, in shard order inside each file.

    Shards are spread over tasks, so one bucket does not become one file.
    """
    features.repartition(order[0]).sortWithinPartitions(bucket, *order).write.partitionBy(bucket).parquet(path)
