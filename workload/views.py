"""The given tables read as image-caption data, for Spark and as SQL.

The tables hold no images, so image sizes are made up from keys; see FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framekiln.operators.buckets import Bins, aspect_ratio, nearest_bin
from framekiln.operators.numbering import with_ordinal
from framekiln.session import bound_batches

BINS = Bins.from_sizes([(512 + 64 * i, 1048576 // (512 + 64 * i) // 64 * 64) for i in range(25)])
RANKS = 4
BATCH = 8
RANK_BATCH = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, shard_idx, pos, height, width, caption`` from documents."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.format_string("%09d", doc).alias("key"),
        F.substring("source", 4, 9).cast("int").alias("shard_idx"),
        doc.alias("pos"),
        (256 + doc * 7919 % 1793).cast("int").alias("height"),
        (256 + (doc * 104729 + F.col("n_chars")) % 1793).cast("int").alias("width"),
        F.col("text").alias("caption"),
    )


def bucketed(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Samples with their rank and nearest bucket."""
    rows = samples(spark, sf_dir).withColumn("ratio", aspect_ratio(F.col("height"), F.col("width")))
    placed = nearest_bin(rows, BINS).withColumn("rank", F.pmod("shard_idx", F.lit(RANKS)))
    return placed.select("key", "shard_idx", "pos", "rank", "bucket", *columns)


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions with duplicates, of which the later one counts."""
    labels = table(spark, sf_dir, "labels")
    draft = labels.select("doc_id", F.lit(0).alias("pos"), F.concat(F.lit("draft "), F.col("doc_id").cast("string")).alias("caption"))
    final = labels.filter("quality = 1").select(
        "doc_id", F.lit(1).alias("pos"), F.concat(F.lit("final "), F.col("doc_id").cast("string")).alias("caption")
    )
    return draft.unionByName(final)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq_id, xs``: short sequences of numbers from embeddings, in vec_id order."""
    rows = table(spark, sf_dir, "embeddings").select(
        (F.col("label") * 1000 + F.floor(F.col("vec_id") / 20)).alias("seq_id"),
        "vec_id",
        F.get("embedding", F.lit(0)).cast("double").alias("x"),
    )
    # A sequence has at most 20 items, as its vec_ids share a quotient by 20.
    packed = rows.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("vec_id", "x"))).alias("v"))
    return packed.select("seq_id", F.col("v.x").alias("xs"))


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rank, micro, loss`` from events."""
    rows = table(spark, sf_dir, "events").select(
        F.pmod("user_id", F.lit(4)).alias("rank"), "event_id", F.col("value").alias("loss")
    )
    return with_ordinal(rows, ["event_id"], ["rank"], name="micro").drop("event_id")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 8).alias("step"),
        F.pmod("event_id", F.lit(8)).alias("trial"),
        F.col("event_id").alias("state"),
        F.col("value").alias("loss"),
    )


SAMPLES_SQL = """samples_v AS (
  SELECT printf('%09d', doc_id) AS key, CAST(substr(source, 4) AS INT) AS shard_idx, doc_id AS pos,
         CAST(256 + (doc_id * 7919) % 1793 AS INT) AS height,
         CAST(256 + (doc_id * 104729 + n_chars) % 1793 AS INT) AS width,
         text AS caption
  FROM documents)"""

BINS_SQL = """bins_v AS (
  SELECT CAST(i AS INT) AS ord, CAST(512 + 64*i AS INT) AS height,
         CAST((1048576 // (512 + 64*i) // 64) * 64 AS INT) AS width,
         CAST(512 + 64*i AS DOUBLE) / ((1048576 // (512 + 64*i) // 64) * 64) AS ratio
  FROM range(25) t(i))"""

BUCKETED_SQL = f"""{SAMPLES_SQL},
{BINS_SQL},
bucketed_v AS (
  SELECT s.*, s.shard_idx % 4 AS rank, n.ratio AS bucket, n.height AS target_height, n.width AS target_width
  FROM samples_v s, bins_v n
  QUALIFY row_number() OVER (PARTITION BY s.key ORDER BY abs(n.ratio - s.height::DOUBLE / s.width), n.ord) = 1)"""

CAPTIONS_SQL = """captions_v AS (
  SELECT doc_id, 0 AS pos, concat('draft ', doc_id) AS caption FROM labels
  UNION ALL
  SELECT doc_id, 1 AS pos, concat('final ', doc_id) AS caption FROM labels WHERE quality = 1)"""

TOKENS_SQL = """tokens_v AS (
  SELECT label * 1000 + vec_id // 20 AS seq_id, vec_id, embedding[1]::DOUBLE AS x,
         row_number() OVER (PARTITION BY label * 1000 + vec_id // 20 ORDER BY vec_id) AS i,
         count(*) OVER (PARTITION BY label * 1000 + vec_id // 20) AS n
  FROM embeddings)"""

LOG_SQL = """log_v AS (
  SELECT user_id % 4 AS rank, value AS loss,
         row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS micro
  FROM events)"""

TRIALS_SQL = """trials_v AS (
  SELECT event_id // 8 AS step, event_id % 8 AS trial, event_id AS state, value AS loss FROM events)"""


def draw_sql(seed: str, *keys: str) -> str:
    """The SQL text of a seeded 32-bit draw."""
    parts = ", ".join([seed, *keys])
    return f"('0x' || substr(md5(concat_ws('|', {parts})), 1, 8))::BIGINT"
