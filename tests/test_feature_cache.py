"""Snapshots of the feature cache, and precomputing in emission order without a second shuffle."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from framekiln.operators.feature_cache import FeatureCache
from framekiln.plans import precompute
from framekiln.session import fresh_path
from workload import media

SCHEMA = "key string, latent double, _error string"


@pytest.fixture()
def cache(spark):
    return FeatureCache(spark, fresh_path(spark, "test-cache"), SCHEMA, ["key"])


def samples(spark, names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def encode(rows):
    return rows.withColumns({"latent": F.length("key").cast("double"), "_error": F.when(F.col("key") == "bad", F.lit("no image"))})


def keys(frame):
    return sorted(r.key for r in frame.collect())


def test_refresh_encodes_what_is_missing(spark, cache):
    assert cache.read().collect() == [] and cache.snapshot() == (-1, [])
    assert cache.refresh(samples(spark, ["a", "b", "b", "bad"]), encode) == 3
    assert cache.refresh(samples(spark, ["a", "b"]), encode) == 0 and cache.snapshot()[0] == 0
    assert cache.refresh(samples(spark, ["a", "c", "bad"]), encode) == 2  # what failed is tried again
    assert keys(cache.features(samples(spark, ["a", "c", "bad", "d"]))) == ["a", "c"]


def test_failed_refresh_leaves_the_snapshot(spark, cache):
    cache.refresh(samples(spark, ["a"]), encode)
    with pytest.raises(Exception):
        cache.refresh(samples(spark, ["b"]), lambda rows: encode(rows).withColumn("latent", F.raise_error(F.lit("no")).cast("double")))
    assert cache.snapshot()[0] == 0 and keys(cache.read()) == ["a"]
    assert cache.refresh(samples(spark, ["b"]), encode) == 1 and keys(cache.read()) == ["a", "b"]


def test_readers_keep_their_snapshot(spark, cache):
    cache.refresh(samples(spark, ["a", "bad"]), encode)
    held = cache.read()
    cache.refresh(samples(spark, ["b"]), encode)
    cache.compact()
    assert keys(held) == ["a", "bad"] and keys(cache.read()) == ["a", "b"] and len(cache.snapshot()[1]) == 1
    assert cache.vacuum() == 2 and keys(cache.read()) == ["a", "b"] and cache.vacuum() == 0


def test_two_writers(spark, cache):
    cache.refresh(samples(spark, ["a"]), encode)
    with pytest.raises(RuntimeError, match="another writer"):
        cache._commit(0, [])


def test_no_exchange_above_the_encoder(spark, sf_dir):
    shards = media.image_shards(spark, sf_dir, "tar-plan")
    index = precompute.image_index(spark, shards, precompute.nearest(media.SMALL_BINS))
    dealt = precompute.in_emission_order(precompute.batching.bucket_batches(index, 8), 8, 100)
    rows = precompute.encode_batches(
        precompute.by_feature_shard(dealt, 4), media.toy_image_model, media.word_lengths, 8, 8, arrange=False
    )
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        rows.explain()
    plan = out.getvalue()
    above = plan[: plan.index("MapInArrow")]  # the fetch of members lies under the encoders
    assert "ArrowEvalPython" in above and "Exchange" not in above
