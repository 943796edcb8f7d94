import pytest
from pyspark.sql import functions as F

from framekiln.functions import vectors as V
from framekiln.operators import features


def test_encoder_calls_are_small_and_of_one_bucket(spark):
    def factory():
        return lambda part: [f"{len(part)}:{min(part)}-{max(part)}" for _ in part]

    df = spark.createDataFrame([(i, float(i // 7)) for i in range(20)], "v int, bucket double").coalesce(1)
    encode = features.encoder(factory, "string", 4)
    got = df.withColumn("call", encode(F.col("v"), F.col("bucket"))).collect()
    for r in got:
        size, span = r.call.split(":")
        low, high = map(int, span.split("-"))
        assert int(size) <= 4 and low // 7 == high // 7 == r.v // 7 and low <= r.v <= high


def test_encoder_must_return_as_many(spark):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    encode = features.encoder(lambda: lambda part: [0], "int", 4)
    with pytest.raises(Exception, match="outputs"):
        df.coalesce(1).select(encode(F.col("v"))).collect()


def test_cache_encodes_each_sample_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    seen = spark.sparkContext.accumulator(0)

    def encode(misses):
        def count(parts):
            for pdf in parts:
                seen.add(len(pdf))
                yield pdf.assign(latent=pdf["key"].str.len(), _error=[("bad" if k == "k3" else None) for k in pdf["key"]])

        return misses.mapInPandas(count, "key string, latent int, _error string")

    def refresh(n):
        samples = spark.createDataFrame([(f"k{i}",) for i in range(n)], "key string")
        return features.refresh_cache(spark, samples, path, "key string, latent int, _error string", ["key"], encode)

    assert refresh(5).count() == 4 and seen.value == 5
    # The flagged row is tried again; the others come from the cache.
    assert refresh(5).count() == 4 and seen.value == 6
    assert refresh(8).count() == 7 and seen.value == 10
    assert {r.key for r in refresh(2).collect()} == {"k0", "k1"}


def test_pad_then_trim_is_the_identity(spark):
    df = spark.createDataFrame([(i, [float(j) for j in range(i)]) for i in range(7)], "n int, x array<double>")
    padded = df.select("n", "x", V.pad(F.col("x"), 6, F.lit(0.0)).alias("p"), V.mask(F.col("x"), 6).alias("m"))
    for r in padded.withColumn("back", V.mask_trim(F.col("p"), F.col("m"))).collect():
        assert len(r.p) == len(r.m) == 6 and sum(r.m) == r.n and r.back == r.x


def test_long_sequences(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    assert df.select(V.pad(F.col("x"), 2, F.lit(0.0)).alias("p")).first().p == [1.0, 2.0]
    assert df.select(V.mask(F.col("x"), 2).alias("m")).first().m == [1, 1]
    with pytest.raises(Exception, match="longer"):
        df.select(V.pad(F.col("x"), 2, F.lit(0.0), on_long="error")).collect()


def test_token_padding(spark):
    df = spark.createDataFrame([([[1.0, 2.0]],)], "x array<array<float>>")
    assert df.select(V.pad(F.col("x"), 3, V.zero_token(2)).alias("p")).first().p == [[1.0, 2.0], [0.0, 0.0], [0.0, 0.0]]


def test_head_tail(spark):
    df = spark.createDataFrame([(list(range(9)),), (list(range(3)),)], "x array<int>")
    assert [r.h for r in df.select(V.head_tail(F.col("x"), 4).alias("h")).collect()] == [[0, 6, 7, 8], [0, 0, 1, 2]]


def test_cache_scan(spark):
    cache = spark.range(100).withColumnRenamed("id", "cache_idx").repartition(5)
    assert [r.cache_idx for r in features.cache_scan(cache, 5, 3).collect()] == list(range(15))
