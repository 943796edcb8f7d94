"""Streaming queries over files that Spark writes from the tables."""

import os

from pyarrow.fs import LocalFileSystem
from pyspark.sql import functions as F

from framekiln.functions import fields
from framekiln.session import fresh_path
from framekiln.sources import tar
from framekiln.streaming import arrival, batcher, committed, losses, reshard, sinks
from workload.media import SMALL_SQL, image_shards, sample_id
from workload.registry import query
from workload.views import LOG_SQL, RANKS, table, train_log

FILES = 3


def arriving_events(spark, sf_dir):
    """Events as a stream of a few files: ``rank, bucket, shard_idx, pos``."""
    path = fresh_path(spark, "events")
    table(spark, sf_dir, "events").select(
        F.pmod("event_id", F.lit(RANKS)).alias("rank"),
        F.col("event_type").alias("bucket"),
        F.pmod("event_id", F.lit(FILES)).alias("shard_idx"),
        F.col("event_id").alias("pos"),
    ).repartition(FILES).write.parquet(path)
    return arrival.arriving_rows(spark, path, spark.read.parquet(path).schema, max_files=1)


@query(
    "stream_bucket_batches",
    """WITH c AS (SELECT event_id % 4 AS rank, event_type AS bucket, count(*) // 16 AS batches FROM events GROUP BY ALL)
SELECT rank, bucket, batches, batches * 16 AS rows FROM c WHERE batches > 0""",
)
def stream_bucket_batches(spark, sf_dir):
    stream = batcher.stream_bucket_batches(arriving_events(spark, sf_dir), 16)
    table_ = sinks.drained(spark, stream, "stream-batches")
    per_batch = table_.groupBy("rank", "bucket", "batch_no").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("slots"))
    return per_batch.filter("n = 16 AND slots = 16").groupBy("rank", "bucket").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("n").alias("rows")
    )


def events_in_steps(spark, sf_dir, files):
    """Narrow events of ranks in step, as files that hold whole steps and come one after the other."""
    path = fresh_path(spark, "steps")
    events = table(spark, sf_dir, "events").select(
        F.pmod("event_id", F.lit(RANKS)).alias("rank"),
        F.col("event_type").alias("bucket"),
        F.floor(F.col("event_id") / F.lit(RANKS)).alias("step"),
        F.col("event_id").alias("pos"),
    )
    last = events.agg(F.max("step")).first()[0] or 0
    for i in range(files):
        part = events.filter(F.floor(F.col("step") * F.lit(files) / F.lit(last + 1)) == i)
        part.coalesce(1).write.mode("append").parquet(path)
    return arrival.arriving_rows(spark, path, events.schema, max_files=1)


@query(
    "stream_bounded",
    """WITH RECURSIVE timed AS (
  SELECT event_id AS pos, event_id % 4 AS rank, event_type AS bucket, event_id // 4 AS t FROM events),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY bucket, rank ORDER BY t) - 1 AS k,
         coalesce(lead(t, 16) OVER (PARTITION BY bucket, rank ORDER BY t), 1e15::BIGINT) AS later FROM timed),
following AS (
  SELECT DISTINCT bucket, t, max(later) OVER (PARTITION BY bucket ORDER BY t) AS nxt FROM placed),
chain(bucket, e) AS (
  SELECT bucket, max(t) FROM placed WHERE k = 15 GROUP BY bucket HAVING count(*) = 4
  UNION ALL
  SELECT c.bucket, f.nxt FROM chain c JOIN following f ON f.bucket = c.bucket AND f.t = c.e WHERE f.nxt < 1e15::BIGINT),
emitted AS (SELECT bucket, e, row_number() OVER (PARTITION BY bucket ORDER BY e) - 1 AS batch_no FROM chain),
windowed AS (SELECT p.*, e.batch_no FROM placed p ASOF JOIN emitted e ON p.bucket = e.bucket AND p.t <= e.e),
slots AS (SELECT *, row_number() OVER (PARTITION BY bucket, rank, batch_no ORDER BY k DESC) AS place FROM windowed)
SELECT bucket, batch_no, rank, row_number() OVER (PARTITION BY bucket, rank, batch_no ORDER BY k) - 1 AS slot, pos
FROM slots WHERE place <= 16""",
)
def stream_bounded(spark, sf_dir):
    stream = batcher.stream_bounded_batches(events_in_steps(spark, sf_dir, FILES), RANKS, 16, order=["step"])
    table_ = sinks.drained(spark, stream, "stream-bounded")
    return table_.select("bucket", "batch_no", "rank", "slot", "pos")


@query(
    "stream_shards",
    f"""WITH {SMALL_SQL}
SELECT i // 64 AS shard_idx, printf('%06d', i % 64) AS key, pos AS doc_id, md5(caption) AS digest FROM small_v""",
)
def stream_shards(spark, sf_dir):
    path = image_shards(spark, sf_dir, "tar-arriving")
    stream = arrival.arriving_shards(spark, path, fields=["txt", "id"], split_bytes=100000)
    rows = sinks.drained(
        spark,
        stream.select("shard_idx", "key", sample_id(), F.md5(fields.field(F.col("fields"), "txt")).alias("digest")),
        "stream-shards",
    )
    return rows


@query(
    "stream_reshard",
    """WITH n AS (SELECT event_id % 4 AS rank, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1 AS i FROM events)
SELECT rank, i // 100 AS shard_no, count(*) AS rows, max(printf('%06d', i % 100)) AS last_key FROM n GROUP BY ALL""",
)
def stream_reshard(spark, sf_dir):
    stream = reshard.stream_reshard(arriving_events(spark, sf_dir), 100)
    dealt = sinks.drained(spark, stream, "stream-reshard", ["rank", "shard_no"])
    return dealt.groupBy("rank", "shard_no").agg(
        F.count_distinct("shard_pos").alias("rows"), F.max("shard_key").alias("last_key")
    )


@query(
    "stream_loss",
    f"""WITH {LOG_SQL}
SELECT micro // 4 AS step, round(sum(loss) / 4, 6) AS loss FROM log_v GROUP BY ALL HAVING count(*) = 16""",
)
def stream_loss(spark, sf_dir):
    path = fresh_path(spark, "loss-log")
    log = train_log(spark, sf_dir)
    log.repartition(FILES).write.parquet(path)
    stream = losses.step_losses(arrival.arriving_rows(spark, path, log.schema, max_files=1), RANKS, 4)
    return sinks.drained(spark, stream, "stream-loss").withColumn("loss", F.round("loss", 6))


@query(
    "stream_loss_updates",
    f"""WITH {LOG_SQL}
SELECT micro // 4 AS step, round(sum(loss) / 4, 6) AS loss, count(*) AS rows FROM log_v GROUP BY ALL""",
)
def stream_loss_updates(spark, sf_dir):
    """The running log of all steps, unfinished ones too: updates merged by step."""
    path = fresh_path(spark, "loss-updates")
    log = train_log(spark, sf_dir)
    log.repartition(FILES).write.parquet(f"{path}/log")
    stream = losses.step_updates(arrival.arriving_rows(spark, f"{path}/log", log.schema, max_files=1), RANKS, 4)
    committed.run_updates(stream, f"{path}/table", f"{path}/checkpoint")
    return committed.latest_rows(spark, f"{path}/table", stream.schema, ["step"]).withColumn("loss", F.round("loss", 6))


def landed_in_order(path):
    """Give the shards of a folder times of landing in the order of their numbers; tasks wrote them side by side.

    A stream takes the oldest first. Only local files can be given a time; a folder in another store stays as it is.
    """
    shards = tar.listed(path)
    first = min((int(version) for _, _, version in shards), default=0) // 10**6
    for i, (name, _, _) in enumerate(shards):
        store, inside = tar.open_store(name)
        if isinstance(store, LocalFileSystem):
            os.utime(inside, ns=((first + i) * 10**6,) * 2)
    return path


@query(
    "stream_tar_shards",
    f"""WITH {SMALL_SQL}, n AS (SELECT *, count(*) OVER () AS n FROM small_v)
SELECT i // 50 AS shard_no, printf('%06d', i % 50) AS key, pos AS doc_id, md5(caption) AS digest FROM n WHERE i // 50 < n // 50""",
)
def stream_tar_shards(spark, sf_dir):
    """Arriving shards of 64 as new shards of 50; the last, shorter one stays in the state."""
    path = landed_in_order(image_shards(spark, sf_dir, "tar-rolling"))
    out = fresh_path(spark, "tar-rolled")
    narrow = arrival.arriving_shards(spark, path, fields=[], bad_samples="drop", required=["txt", "id"])
    narrow = narrow.select(F.lit(0).alias("rank"), F.lit("all").alias("bucket"), "shard_idx", "pos", "shard")
    whole = batcher.stream_bucket_batches(narrow, 50)
    committed.stream_to_shards(whole, f"{out}/shards", f"{out}/checkpoint", ["txt", "id"])
    rows = tar.tar_scan(spark, f"{out}/shards/rank-00000", fields=["txt", "id"], ignore_missing=True)
    return rows.select(F.col("shard_idx").alias("shard_no"), "key", sample_id(), F.md5(fields.field(F.col("fields"), "txt")).alias("digest"))
