"""Folders of a drained stream are written by many tasks, each by one."""

import glob

from pyspark.sql import functions as F

from framekiln.streaming import arrival, reshard, sinks


def test_shards_of_one_rank_are_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(400).select(F.lit(0).alias("rank"), F.lit(0).alias("shard_idx"), F.col("id").alias("pos"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    dealt = reshard.stream_reshard(arrival.arriving_rows(spark, f"{tmp_path}/in", rows.schema), 10)
    sinks.drain(dealt, f"{tmp_path}/table", f"{tmp_path}/mark", ["rank", "shard_no"])
    files = glob.glob(f"{tmp_path}/table/rank=0/shard_no=*/part-*.parquet")
    tasks = {name.rpartition("/")[2].split("-")[1] for name in files}
    assert len(files) == 40 and len(tasks) > 4
    got = spark.read.parquet(f"{tmp_path}/table").select("shard_no", "shard_pos", "pos").collect()
    assert sorted(map(tuple, got)) == [(i // 10, i % 10, i) for i in range(400)]
