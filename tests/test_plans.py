"""The shapes of the physical plans."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from workload import batches, shards, texts
from workload.registry import QUERIES


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


NO_SHUFFLE = "nearest_bin target_size patch_grid project_fields class_label remove_word caption_guard json_fields".split()


@pytest.mark.parametrize("name", NO_SHUFFLE)
def test_row_by_row_operators_do_not_shuffle(spark, sf_dir, name):
    assert "Exchange" not in plan(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["bucket_batches", "sync_batches", "shard_numbering", "caption_join", "shuffle_global"])
def test_no_cross_joins(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_counting_reads_only_its_columns(spark, sf_dir):
    text = plan(batches.bucket_batches(spark, sf_dir))
    schemas = re.findall(r"ReadSchema: struct<(.*)>", text)
    assert schemas and all("text" not in s and "lang" not in s for s in schemas)


@pytest.mark.parametrize(
    "query, column",
    [
        (batches.bucket_batches_lineitem, "l_partkey"),
        (batches.bucket_batches, "key"),
        (batches.rank_batches, "key"),
        (batches.sync_batches, "key"),
        (batches.repeat_batches, "key"),
        (shards.shard_numbering, "key"),
        (shards.epoch_cycle, "key"),
    ],
)
def test_rows_are_shuffled_once(spark, sf_dir, query, column):
    """Without broadcasts the join with the offsets reuses the window's partitioning."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(query(spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    inputs = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", text)
    assert sum(f" {column}#" in f" {columns}" for columns in inputs) == 1


def test_row_windows_are_cut_into_blocks(spark, sf_dir):
    text = plan(batches.bucket_batches(spark, sf_dir))
    windows = re.findall(r"\(\d+\) Window.*\nInput \[\d+\]: .*\nArguments: (.*)", text)
    row_numbers = [w for w in windows if "row_number" in w]
    assert row_numbers and all("__block" in w for w in row_numbers)


def test_cache_scan_pushes_its_bound(spark, tmp_path):
    from framekiln.operators.features import cache_scan

    spark.range(100).withColumnRenamed("id", "cache_idx").write.parquet(str(tmp_path / "c"))
    text = plan(cache_scan(spark.read.parquet(str(tmp_path / "c")), 5, 2))
    assert "LessThan(cache_idx,10)" in text


def test_pooling_sums_before_the_shuffle(spark, sf_dir):
    text = plan(texts.mean_pool(spark, sf_dir))
    assert "Generate" in text and text.count("ObjectHashAggregate") + text.count("SortAggregate") >= 2


def test_last_wins_reduces_before_the_shuffle(spark, sf_dir):
    text = plan(shards.last_wins(spark, sf_dir))
    assert "Window" not in text and "partial_max_by" in text


def test_session_settings(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.range(1).select(F.lit(1)).count() == 1
