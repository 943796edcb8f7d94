"""Buckets, batches, counts and steps."""

from pyspark.sql import functions as F

from framekiln.operators import batching, buckets, lockstep, metrics, sampling
from framekiln.session import fresh_path
from workload.registry import query
from workload.views import (
    BATCH,
    BINS,
    BUCKETED_SQL,
    LOG_SQL,
    RANK_BATCH,
    RANKS,
    TRIALS_SQL,
    bucketed,
    draw_sql,
    samples,
    table,
    train_log,
    trials,
)

NUMBERED_SQL = f"""{BUCKETED_SQL},
numbered_v AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY shard_idx, pos) - 1 AS i,
         count(*) OVER (PARTITION BY bucket) AS n FROM bucketed_v),
batches_v AS (
  SELECT bucket, i // 8 AS batch_no, i % 8 AS slot, key, caption, shard_idx, pos
  FROM numbered_v WHERE i // 8 < n // 8)"""

RANK_NUMBERED_SQL = f"""{BUCKETED_SQL},
ranked_v AS (
  SELECT *, row_number() OVER (PARTITION BY bucket, rank ORDER BY shard_idx, pos) - 1 AS i,
         count(*) OVER (PARTITION BY bucket, rank) AS n FROM bucketed_v)"""


def full_batches(spark, sf_dir, *columns):
    return batching.bucket_batches(bucketed(spark, sf_dir, *columns), BATCH)


@query("nearest_bin", f"WITH {BUCKETED_SQL} SELECT key, bucket FROM bucketed_v")
def nearest_bin(spark, sf_dir):
    return bucketed(spark, sf_dir).select("key", "bucket")


@query(
    "nearest_bin_sizes",
    f"WITH {BUCKETED_SQL} SELECT key, bucket, target_height, target_width FROM bucketed_v",
)
def nearest_bin_sizes(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("ratio", buckets.aspect_ratio(F.col("height"), F.col("width")))
    placed = buckets.nearest_bin(rows, BINS, limit=100.0, fallback=0.6, sizes=True)
    return placed.select("key", "bucket", "target_height", "target_width")


MANY_BINS = buckets.Bins(tuple(((500 + i * 7919 % 2000) / 1000, 1, 1) for i in range(2000)))


@query(
    "nearest_bin_many",
    """WITH n AS (SELECT i, (500 + i * 7919 % 2000) / 1000.0::DOUBLE AS b FROM range(2000) t(i)),
p AS (SELECT printf('%09d', doc_id) AS key, CAST(256 + (doc_id * 7919) % 1793 AS DOUBLE) / CAST(256 + (doc_id * 104729 + n_chars) % 1793 AS INT) AS ratio
      FROM documents)
SELECT key, CASE WHEN abs(b - ratio) < 0.25 THEN b ELSE -1.0 END AS bucket FROM p, n
QUALIFY row_number() OVER (PARTITION BY key ORDER BY abs(b - ratio), i) = 1""",
)
def nearest_bin_many(spark, sf_dir):
    """A table of 2,000 bins."""
    rows = samples(spark, sf_dir).withColumn("ratio", buckets.aspect_ratio(F.col("height"), F.col("width")))
    return buckets.nearest_bin(rows, MANY_BINS, limit=0.25).select("key", "bucket")


@query(
    "nearest_bin_gap",
    f"""WITH {BUCKETED_SQL},
p AS (SELECT key, height::DOUBLE / width AS ratio FROM samples_v),
q AS (SELECT key, p.ratio AS own, n.ratio AS b, n.ord FROM p, bins_v n
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY abs(n.ratio - p.ratio), n.ord) = 1)
SELECT key, CASE WHEN abs(b - own) < 0.02 THEN b ELSE 1.0 END AS bucket FROM q""",
)
def nearest_bin_gap(spark, sf_dir):
    """A limit narrower than the gaps between bins."""
    rows = samples(spark, sf_dir).withColumn("ratio", buckets.aspect_ratio(F.col("height"), F.col("width")))
    return buckets.nearest_bin(rows, BINS, limit=0.02, fallback=1.0).select("key", "bucket")


@query("target_size", f"WITH {BUCKETED_SQL} SELECT key, target_height, target_width FROM bucketed_v")
def target_size(spark, sf_dir):
    return buckets.target_size(bucketed(spark, sf_dir), BINS).select("key", "target_height", "target_width")


@query(
    "nearest_open_bucket",
    f"""WITH {BUCKETED_SQL},
open_v AS (SELECT DISTINCT bucket AS b FROM bucketed_v SEMI JOIN labels ON labels.doc_id = bucketed_v.pos),
probe_v AS (SELECT key, CASE WHEN pos % 13 = 0 THEN -1.0 ELSE height::DOUBLE / width END AS ratio FROM samples_v)
SELECT key, CASE WHEN ratio = -1.0 THEN -1.0 ELSE b END AS bucket FROM probe_v, open_v
QUALIFY row_number() OVER (PARTITION BY key ORDER BY abs(b - ratio), b) = 1""",
)
def nearest_open_bucket(spark, sf_dir):
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"))
    seen = bucketed(spark, sf_dir).join(labelled, "pos", "left_semi")
    rows = samples(spark, sf_dir).withColumn(
        "ratio",
        F.when(F.pmod("pos", F.lit(13)) == 0, F.lit(-1.0)).otherwise(
            buckets.aspect_ratio(F.col("height"), F.col("width"))
        ),
    )
    return buckets.nearest_open_bucket(rows, seen).select("key", "bucket")


@query(
    "nearest_in_class",
    f"""WITH {BUCKETED_SQL},
probe_v AS (SELECT key, pos % 2 AS is_reg, height::DOUBLE / width AS ratio FROM samples_v)
SELECT key, p.is_reg, n.ratio AS bucket FROM probe_v p JOIN bins_v n ON p.is_reg = n.ord % 2
QUALIFY row_number() OVER (PARTITION BY key ORDER BY abs(n.ratio - p.ratio), n.ord) = 1""",
)
def nearest_in_class(spark, sf_dir):
    rows = samples(spark, sf_dir).select(
        "key",
        F.pmod("pos", F.lit(2)).alias("is_reg"),
        buckets.aspect_ratio(F.col("height"), F.col("width")).alias("ratio"),
    )
    by_class = {0: BINS.ratios[0::2], 1: BINS.ratios[1::2]}
    return buckets.nearest_in_class(rows, by_class, "is_reg").select("key", "is_reg", "bucket")


@query(
    "bucket_readiness",
    f"""WITH {BUCKETED_SQL},
c AS (SELECT bucket, rank, count(*) AS rows FROM bucketed_v GROUP BY ALL)
SELECT bucket, CASE WHEN count(*) = 4 THEN min(rows) ELSE 0 END AS min_rows,
       CASE WHEN count(*) = 4 THEN min(rows) ELSE 0 END >= 4 AS ready
FROM c GROUP BY bucket""",
)
def bucket_readiness(spark, sf_dir):
    return buckets.bucket_readiness(bucketed(spark, sf_dir), RANKS, RANK_BATCH)


@query(
    "ratio_counts",
    f"""WITH {BUCKETED_SQL},
m AS (SELECT CASE WHEN pos % 10 = 0 THEN -1.0 ELSE bucket END AS bucket FROM bucketed_v)
SELECT bucket, count(*) AS rows FROM m WHERE bucket <> -1.0 GROUP BY bucket""",
)
def ratio_counts(spark, sf_dir):
    rows = bucketed(spark, sf_dir).withColumn(
        "bucket", F.when(F.pmod("pos", F.lit(10)) == 0, F.lit(-1.0)).otherwise(F.col("bucket"))
    )
    return buckets.ratio_counts(rows)


@query(
    "pair_counts",
    f"""WITH {BUCKETED_SQL}
SELECT pos % 2 AS is_reg, bucket, count(*) AS rows FROM bucketed_v GROUP BY ALL""",
)
def pair_counts(spark, sf_dir):
    return buckets.pair_counts(bucketed(spark, sf_dir).withColumn("is_reg", F.pmod("pos", F.lit(2))))


@query("bucket_batches", f"WITH {NUMBERED_SQL} SELECT bucket, batch_no, slot, key FROM batches_v")
def bucket_batches(spark, sf_dir):
    """Flagship: full aspect-ratio batches in arrival order."""
    return full_batches(spark, sf_dir).select("bucket", "batch_no", "slot", "key")


@query(
    "bucket_batches_lineitem",
    """WITH bins_v AS (
  SELECT CAST(i AS INT) AS ord,
         CAST(512 + 64*i AS DOUBLE) / ((1048576 // (512 + 64*i) // 64) * 64) AS ratio
  FROM range(25) t(i)),
s AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         (256 + (l_partkey * 7919 + l_linenumber) % 1793)::DOUBLE
           / (256 + (l_suppkey * 104729 + l_orderkey) % 1793) AS r
  FROM lineitem),
edges AS (
  SELECT *, (SELECT first(b.ratio ORDER BY abs(b.ratio - s.r), b.ord) FROM bins_v b) AS bucket FROM s),
m AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i,
         count(*) OVER (PARTITION BY bucket) AS n FROM edges)
SELECT bucket, i // 8 AS batch_no, i % 8 AS slot, l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM m WHERE i // 8 < n // 8""",
)
def bucket_batches_lineitem(spark, sf_dir):
    """The flagship on the largest table."""
    height = 256 + (F.col("l_partkey") * 7919 + F.col("l_linenumber")) % 1793
    width = 256 + (F.col("l_suppkey") * 104729 + F.col("l_orderkey")) % 1793
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select(*order, buckets.aspect_ratio(height, width).alias("ratio"))
    placed = buckets.nearest_bin(rows, BINS).drop("ratio")
    return batching.bucket_batches(placed, BATCH, order=order, blocks=[F.floor(F.col("l_orderkey") / 16384)])


@query(
    "rank_batches",
    f"""WITH {RANK_NUMBERED_SQL}
SELECT rank, bucket, i // 4 AS batch_no, i % 4 AS slot, key FROM ranked_v WHERE i // 4 < n // 4""",
)
def rank_batches(spark, sf_dir):
    rows = batching.bucket_batches(bucketed(spark, sf_dir), RANK_BATCH, rank="rank")
    return rows.select("rank", "bucket", "batch_no", "slot", "key")


@query(
    "sync_batches",
    f"""WITH {RANK_NUMBERED_SQL},
shared AS (
  SELECT bucket, CASE WHEN count(DISTINCT rank) = 4 THEN min(n // 4) ELSE 0 END AS whole
  FROM ranked_v GROUP BY bucket)
SELECT rank, bucket, i // 4 AS batch_no, i % 4 AS slot, key
FROM ranked_v JOIN shared USING (bucket) WHERE i // 4 < whole""",
)
def sync_batches(spark, sf_dir):
    rows = batching.sync_batches(bucketed(spark, sf_dir), RANKS, RANK_BATCH)
    return rows.select("rank", "bucket", "batch_no", "slot", "key")


def lockstep_sql(kept: str) -> str:
    return f"""WITH RECURSIVE {BUCKETED_SQL},
timed AS (
  SELECT key, rank, bucket, shard_idx, pos,
         row_number() OVER (PARTITION BY rank ORDER BY shard_idx, pos) - 1 AS t FROM bucketed_v),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY bucket, rank ORDER BY t) - 1 AS k,
         coalesce(lead(t, 4) OVER (PARTITION BY bucket, rank ORDER BY t), 1e15::BIGINT) AS later FROM timed),
following AS (
  SELECT DISTINCT bucket, t, max(later) OVER (PARTITION BY bucket ORDER BY t) AS nxt FROM placed),
chain(bucket, e) AS (
  SELECT bucket, max(t) FROM placed WHERE k = 3 GROUP BY bucket HAVING count(*) = 4
  UNION ALL
  SELECT c.bucket, f.nxt FROM chain c JOIN following f ON f.bucket = c.bucket AND f.t = c.e WHERE f.nxt < 1e15::BIGINT),
emitted AS (SELECT bucket, e, row_number() OVER (PARTITION BY bucket ORDER BY e) - 1 AS batch_no FROM chain),
windowed AS (
  SELECT p.*, e.batch_no FROM placed p ASOF JOIN emitted e ON p.bucket = e.bucket AND p.t <= e.e),
slots AS (
  SELECT *, row_number() OVER (PARTITION BY bucket, rank, batch_no ORDER BY k {kept}) AS place FROM windowed)
SELECT rank, bucket, batch_no, row_number() OVER (PARTITION BY bucket, rank, batch_no ORDER BY k) - 1 AS slot, key
FROM slots WHERE place <= 4"""


@query("sync_batches_lockstep", lockstep_sql("ASC"))
def sync_batches_lockstep(spark, sf_dir):
    rows = lockstep.lockstep_batches(bucketed(spark, sf_dir), RANKS, RANK_BATCH)
    return rows.select("rank", "bucket", "batch_no", "slot", "key")


@query("sync_batches_blocks", lockstep_sql("ASC"))
def sync_batches_blocks(spark, sf_dir):
    """Emissions that are followed over many blocks of time."""
    rows = lockstep.lockstep_batches(bucketed(spark, sf_dir), RANKS, RANK_BATCH, block_rows=32)
    return rows.select("rank", "bucket", "batch_no", "slot", "key")


@query("sync_batches_newest", lockstep_sql("DESC"))
def sync_batches_newest(spark, sf_dir):
    rows = lockstep.lockstep_batches(bucketed(spark, sf_dir), RANKS, RANK_BATCH, overflow="newest")
    return rows.select("rank", "bucket", "batch_no", "slot", "key")


@query(
    "repeat_batches",
    f"""WITH {BUCKETED_SQL},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY shard_idx, pos) - 1 AS i,
         count(*) OVER (PARTITION BY bucket) AS n FROM bucketed_v)
SELECT bucket, i // 8 AS super_batch, r.r AS repeat, r.r * 2 + (i % 8) // 4 AS sub_batch, (i % 8) % 4 AS slot, key
FROM numbered, range(5) r(r) WHERE i // 8 < n // 8""",
)
def repeat_batches(spark, sf_dir):
    rows = batching.repeat_batches(bucketed(spark, sf_dir), RANK_BATCH, 2, 5)
    return rows.select("bucket", "super_batch", "repeat", "sub_batch", "slot", "key")


@query(
    "collate",
    f"""WITH {NUMBERED_SQL}
SELECT bucket, batch_no, string_agg(key, ',' ORDER BY slot) AS keys, count(*) AS rows
FROM batches_v GROUP BY ALL""",
)
def collate(spark, sf_dir):
    packed = batching.collate(full_batches(spark, sf_dir), ["key"])
    return packed.select("bucket", "batch_no", F.array_join("key", ",").alias("keys"), F.size("key").cast("long").alias("rows"))


@query(
    "micro_batches",
    f"""WITH {NUMBERED_SQL}
SELECT bucket, batch_no, slot, slot // 3 AS image_slice, slot // 5 AS text_slice, key FROM batches_v""",
)
def micro_batches(spark, sf_dir):
    rows = batching.micro_batches(full_batches(spark, sf_dir), 3, 5)
    return rows.select("bucket", "batch_no", "slot", "image_slice", "text_slice", "key")


@query(
    "step_limit",
    f"""WITH {NUMBERED_SQL},
names AS (SELECT DISTINCT bucket, batch_no FROM batches_v),
seqs AS (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', 17, bucket, batch_no)), bucket, batch_no) - 1 AS batch_seq
  FROM names)
SELECT bucket, batch_no, slot, key, batch_seq FROM batches_v JOIN seqs USING (bucket, batch_no) WHERE batch_seq < 50""",
)
def step_limit(spark, sf_dir):
    rows = batching.step_limit(full_batches(spark, sf_dir), steps=25, seed=17, accumulation=2)
    return rows.select("bucket", "batch_no", "slot", "key", "batch_seq")


@query(
    "uncond_dropout",
    f"""WITH {NUMBERED_SQL},
drawn AS (SELECT *, {draw_sql('5', 'bucket', 'batch_no')} / 4294967296.0 < 0.3 AS dropped FROM batches_v)
SELECT bucket, batch_no, slot, key, dropped, CASE WHEN dropped THEN 0 ELSE length(caption) END AS emb0 FROM drawn""",
)
def uncond_dropout(spark, sf_dir):
    rows = full_batches(spark, sf_dir, "caption").withColumn("emb", F.array(F.length("caption")))
    mixed = sampling.uncond_dropout(rows, 0.3, 5, F.array(F.lit(0)))
    return mixed.select("bucket", "batch_no", "slot", "key", "dropped", F.get("emb", F.lit(0)).alias("emb0"))


ROLLUP_SQL = f"""WITH {LOG_SQL},
per_rank AS (SELECT micro // 4 AS step, rank, sum(loss) AS s, count(*) AS n FROM log_v GROUP BY ALL)
SELECT step, round(avg(s), 6) AS loss, round(avg(s / n), 6) AS mean_loss FROM per_rank GROUP BY step"""


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("loss_rollup", ROLLUP_SQL)
def loss_rollup(spark, sf_dir):
    return rounded(metrics.loss_rollup(train_log(spark, sf_dir), 4), "loss", "mean_loss")


@query("log_sink", ROLLUP_SQL)
def log_sink(spark, sf_dir):
    path = fresh_path(spark, "log")
    metrics.append_log(metrics.loss_rollup(train_log(spark, sf_dir), 4), path)
    return rounded(spark.read.parquet(path), "loss", "mean_loss")


@query(
    "best_of_n",
    f"""WITH {TRIALS_SQL}
SELECT step, trial, state, loss FROM trials_v
QUALIFY row_number() OVER (PARTITION BY step ORDER BY loss, trial) = 1""",
)
def best_of_n(spark, sf_dir):
    return metrics.best_of_n(trials(spark, sf_dir)).select("step", "trial", "state", "loss")
