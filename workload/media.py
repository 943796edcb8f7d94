"""Tar shards, images, encoders and the feature cache, on files that Spark writes from documents."""

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from framekiln.functions import fields, images
from framekiln.operators import batching, buckets, features, sharding
from framekiln.plans import dataset, precompute, training
from framekiln.session import fresh_path
from framekiln.sources import tar, tar_index
from workload.registry import query
from workload.shards import SHARD_SIZE
from workload.views import (
    BATCH,
    BINS,
    BUCKETED_SQL,
    CAPTIONS_SQL,
    RANKS,
    SAMPLES_SQL,
    captions,
    samples,
    table,
)

SMALL_BINS = buckets.Bins.from_sizes([(h, w) for h in (4, 8, 12) for w in (6, 10)])


def png_bytes(pixels: np.ndarray) -> bytes:
    """An RGB PNG file without row filters."""
    height, width, _ = pixels.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.hstack([np.zeros((height, 1), np.uint8), pixels.reshape(height, width * 3)])
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


@F.pandas_udf(BinaryType())
def drawn_png(ids: pd.Series, heights: pd.Series, widths: pd.Series) -> pd.Series:
    """The image of a sample: value (31 id + 7 y + 13 x + 17 c) mod 256."""

    def draw(i, h, w):
        y, x, c = np.ogrid[:h, :w, :3]
        return png_bytes(((31 * i + 7 * y + 13 * x + 17 * c) % 256).astype(np.uint8))

    return pd.Series([draw(*t) for t in zip(ids, heights, widths)])


SMALL_SQL = f"""{SAMPLES_SQL},
small_v AS (
  SELECT *, 4 + height % 13 AS h, 4 + width % 13 AS w,
         row_number() OVER (ORDER BY shard_idx, pos) - 1 AS i FROM samples_v)"""


def small_images(spark, sf_dir):
    """Samples with a small drawn image."""
    return samples(spark, sf_dir).withColumns(
        {"h": 4 + F.pmod("height", F.lit(13)), "w": 4 + F.pmod("width", F.lit(13))}
    ).withColumn("png", drawn_png("pos", "h", "w"))


def image_shards(spark, sf_dir, label, png="png", txt="caption"):
    """A folder of tar shards of all documents: ``png``, ``txt``."""
    path = fresh_path(spark, label)
    rows = small_images(spark, sf_dir)
    dealt = sharding.shard_numbering(rows, SHARD_SIZE)
    members = {"png": F.expr(png), "txt": F.expr(txt), "id": F.col("pos").cast("string")}
    tar.write_shards(tar.by_shard(dealt.withColumns(members)), path, list(members))
    return path


def sample_id(fields_col="fields"):
    return fields.text_field(F.col(fields_col), "id").cast("long").alias("doc_id")


@query(
    "tar_scan",
    f"""WITH {SMALL_SQL}
SELECT i // 64 AS shard_idx, printf('%06d', i % 64) AS key, pos AS doc_id, h AS height, w AS width FROM small_v""",
)
def tar_scan(spark, sf_dir):
    """Sizes from image headers; only the ``id`` members are read in full."""
    path = image_shards(spark, sf_dir, "tar-scan")
    rows = tar.tar_scan(spark, path, fields=["id"], sizes=True, split_bytes=200000)
    return rows.select("shard_idx", "key", sample_id(), "height", "width")


@query(
    "tar_index",
    f"""WITH {SMALL_SQL}
SELECT i // 64 AS shard_idx, printf('%06d', i % 64) AS key, pos AS doc_id, h AS height, w AS width, 3 AS members,
       strlen(caption) AS txt_bytes, md5(caption) AS digest FROM small_v""",
)
def tar_index_(spark, sf_dir):
    """All samples by the member index; ``id`` and ``txt`` are read at their places. A second pass walks no shard."""
    path = image_shards(spark, sf_dir, "tar-indexed")
    index = fresh_path(spark, "tar-index")
    tar_index.refresh_index(spark, path, index)
    rows = tar_index.with_placed_members(tar_index.indexed_samples(spark, path, index), ["id", "txt"], 200000)
    return rows.select(
        "shard_idx",
        "key",
        sample_id(),
        "height",
        "width",
        F.size("members").alias("members"),
        F.filter("places", lambda p: p["ext"] == "txt")[0]["size"].alias("txt_bytes"),
        F.md5(fields.field(F.col("fields"), "txt")).alias("digest"),
    )


@query(
    "tar_pruned",
    f"""WITH {SMALL_SQL}
SELECT i // 64 AS shard_idx, printf('%06d', i % 64) AS key, pos AS doc_id FROM small_v
WHERE (i // 64) <> 1 AND i // 64 <= 40 AND (i % 64) // 10 IN (1, 3) AND pos % 3 <> 0""",
)
def tar_pruned(spark, sf_dir):
    """What the scan leaves out: other shards are not opened, bodies of other samples and of those without ``txt`` not read."""
    path = image_shards(spark, sf_dir, "tar-pruned", txt="CASE WHEN pos % 3 <> 0 THEN caption END")
    shards = [i for i in range(tar.count_shards(path)) if i <= 40 and i != 1]
    rows = tar.tar_scan(spark, path, fields=["id"], required=["txt", "png"], shards=shards, key_prefixes=["00001", "00003"])
    return rows.select("shard_idx", "key", sample_id())


@query(
    "local_shards",
    f"""WITH {SMALL_SQL} SELECT i // 64 AS shard_idx, count(*) AS rows FROM small_v GROUP BY ALL""",
)
def local_shards(spark, sf_dir):
    path = image_shards(spark, sf_dir, "tar-list")
    names = sorted(name for name, _ in tar.expand(path))
    rows = tar.tar_scan(spark, [*names, f"{path}/shard-999999.tar"], fields=[], ignore_missing=True)
    return rows.groupBy("shard_idx").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "reshard_write",
    f"""WITH {SMALL_SQL}
SELECT i // 100 AS shard_idx, printf('%06d', i % 100) AS key, pos AS doc_id, md5(caption) AS digest FROM small_v""",
)
def reshard_write(spark, sf_dir):
    """Shards of 64 dealt into shards of 100 and read back."""
    path = fresh_path(spark, "tar-resharded")
    dataset.reshard(spark, image_shards(spark, sf_dir, "tar-source"), path, 100, members=("png", "txt", "id"))
    back = tar.tar_scan(spark, path, fields=["txt", "id"])
    return back.select("shard_idx", "key", sample_id(), F.md5(fields.field(F.col("fields"), "txt")).alias("digest"))


@query(
    "decode_fields",
    f"""WITH {SMALL_SQL},
p AS (
  SELECT pos, sum((31 * pos + 7 * y.y + 13 * x.x + 17 * c.c) % 256) AS total
  FROM small_v, range(16) y(y), range(16) x(x), range(3) c(c) WHERE y.y < h AND x.x < w GROUP BY pos)
SELECT pos AS doc_id, caption, h AS height, w AS width, total::DOUBLE AS total FROM small_v JOIN p USING (pos)""",
)
def decode_fields(spark, sf_dir):
    rows = tar.tar_scan(spark, image_shards(spark, sf_dir, "tar-decode"), sizes=True)
    image = fields.first_present(F.col("fields"))
    pixels = images.decode_image(image)["pixels"]
    return rows.select(
        sample_id(),
        fields.text_field(F.col("fields")).alias("caption"),
        "height",
        "width",
        F.aggregate(pixels, F.lit(0.0), lambda a, v: a + v).alias("total"),
    )


@query(
    "bad_sample_quarantine",
    f"""WITH {SMALL_SQL}
SELECT pos AS doc_id, pos % 7 <> 0 AS good FROM small_v""",
)
def bad_sample_quarantine(spark, sf_dir):
    """Every seventh image is cut off inside its header."""
    cut = "CASE WHEN pos % 7 = 0 THEN substring(png, 1, 10) ELSE png END"
    path = image_shards(spark, sf_dir, "tar-bad", png=cut)
    good = tar.tar_scan(spark, path, fields=["id"], sizes=True).select(sample_id(), F.lit(True).alias("good"))
    bad = tar.tar_scan(spark, path, fields=["id"], sizes=True, bad_samples="only")
    return good.unionByName(bad.select(sample_id(), F.lit(False).alias("good")))


def mean_colour():
    """A toy image encoder: mean, least and largest value of each image."""
    return lambda pictures: [[float(np.mean(p)), float(np.min(p)), float(np.max(p))] for p in pictures]


def word_lengths():
    """A toy text encoder: one token of two numbers per word."""
    return lambda texts: [[[float(len(w)), 1.0] for w in t.split(" ")] for t in texts]


def placed_images(spark, sf_dir):
    rows = small_images(spark, sf_dir).withColumn("ratio", buckets.aspect_ratio(F.col("h"), F.col("w")))
    placed = buckets.nearest_bin(rows, SMALL_BINS, sizes=True)
    return placed.select("key", "shard_idx", "pos", "bucket", "h", "w", "target_height", "target_width", "png", "caption")


def encoded(rows):
    """Latents and embeddings, a few rows per encoder call."""
    pixels = images.decode_image(F.col("png"))["pixels"]
    image_encoder = features.encoder(mean_colour, "array<float>", 4)
    text_encoder = features.encoder(word_lengths, "array<array<float>>", 3)
    return rows.withColumn("pixels", pixels).withColumns(
        {"latent": image_encoder(F.col("pixels"), F.col("bucket")), "emb": text_encoder(F.col("caption"))}
    )


def total(vector):
    return F.aggregate(vector, F.lit(0.0), lambda a, v: a + v)


PLACED_SQL = f"""{SMALL_SQL},
bins_s AS (
  SELECT row_number() OVER (ORDER BY h.h, w.w) - 1 AS ord, h.h AS th, w.w AS tw, h.h::DOUBLE / w.w AS ratio
  FROM (VALUES (4), (8), (12)) h(h), (VALUES (6), (10)) w(w)),
placed_v AS (
  SELECT s.*, b.ratio AS bucket, th, tw FROM small_v s, bins_s b
  QUALIFY row_number() OVER (PARTITION BY s.key ORDER BY abs(b.ratio - s.h::DOUBLE / s.w), b.ord) = 1),
full_v AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY shard_idx, pos) - 1 AS j,
           count(*) OVER (PARTITION BY bucket) AS n FROM placed_v)
  WHERE j // 8 < n // 8)"""

PIXEL_SQL = """pixel_v AS (
  SELECT pos, avg((31 * pos + 7 * y.y + 13 * x.x + 17 * c.c) % 256) AS mean,
         min((31 * pos + 7 * y.y + 13 * x.x + 17 * c.c) % 256) AS least,
         max((31 * pos + 7 * y.y + 13 * x.x + 17 * c.c) % 256) AS most
  FROM small_v, range(16) y(y), range(16) x(x), range(3) c(c) WHERE y.y < h AND x.x < w GROUP BY pos)"""


@query(
    "encode_features",
    f"""WITH {PLACED_SQL}, {PIXEL_SQL}
SELECT key, bucket, round(mean, 2) AS mean, least::DOUBLE AS least, most::DOUBLE AS most,
       len(string_split(caption, ' ')) AS words,
       (length(caption) - len(string_split(caption, ' ')) + 1)::DOUBLE AS letters
FROM full_v JOIN pixel_v USING (pos)""",
)
def encode_features(spark, sf_dir):
    batches = batching.bucket_batches(placed_images(spark, sf_dir), BATCH, block_rows=4096)
    rows = encoded(features.arranged(batches))
    return rows.select(
        "key",
        "bucket",
        F.round(F.col("latent")[0].cast("double"), 2).alias("mean"),
        F.col("latent")[1].cast("double").alias("least"),
        F.col("latent")[2].cast("double").alias("most"),
        F.size("emb").cast("long").alias("words"),
        total(F.transform("emb", lambda t: t[0].cast("double"))).alias("letters"),
    )


@query("image_transform")
def image_transform(spark, sf_dir):
    rows = placed_images(spark, sf_dir)
    made = images.transform_image(F.col("png"), F.col("target_height"), F.col("target_width"))
    return rows.select("key", "bucket", made.alias("made")).select(
        "key", "bucket", F.size("made.pixels").alias("values"), F.round(total(F.col("made.pixels")), 4).alias("total")
    )


def grid_tokens():
    """A toy vision encoder: a class token, then the mean of each of 16 x 16 patches."""

    def run(pictures):
        out = []
        for flat, height, width in ((p["pixels"], p["height"], p["width"]) for p in pictures):
            pixels = np.asarray(flat, np.float32).reshape(3, height, width)
            patches = images.vision_input(pixels).reshape(3, 16, 14, 16, 14).mean(axis=(2, 4)).reshape(3, 256).T
            out.append([[0.0, 0.0, 0.0], *patches.tolist()])
        return out

    return run


@query("encode_vision")
def encode_vision(spark, sf_dir):
    rows = placed_images(spark, sf_dir)
    made = images.transform_image(F.col("png"), F.col("target_height"), F.col("target_width"))["pixels"]
    picture = F.struct(made.alias("pixels"), F.col("target_height").alias("height"), F.col("target_width").alias("width"))
    vision = features.encoder(grid_tokens, "array<array<float>>", 8)
    # The first token stands for the whole image and is not used.
    found = rows.withColumn("picture", picture).withColumn("vision", vision(F.col("picture"), F.col("bucket")))
    patches = F.slice("vision", 2, fields.VISION_GRID * fields.VISION_GRID)
    return found.select(
        "key", F.size(patches).alias("tokens"), F.round(total(F.transform(patches, lambda t: t[0].cast("double"))), 2).alias("red")
    )


@query(
    "feature_write",
    f"""WITH {BUCKETED_SQL},
dealt AS (SELECT *, row_number() OVER (ORDER BY shard_idx, pos) - 1 AS i FROM bucketed_v)
SELECT i // 64 AS shard_no, printf('%07d', i % 64) AS key, round(bucket, 6) AS ratio, length(caption) AS latent0 FROM dealt""",
)
def feature_write(spark, sf_dir):
    back = written_features(spark, sf_dir, "features")
    return back.select("shard_no", "key", F.round("ratio", 6).alias("ratio"), F.col("latent")[0].alias("latent0"))


def written_features(spark, sf_dir, label):
    rows = samples(spark, sf_dir).withColumn("ratio", buckets.aspect_ratio(F.col("height"), F.col("width")))
    placed = buckets.nearest_bin(rows, BINS).select("shard_idx", "pos", "bucket", F.array(F.length("caption")).alias("latent"))
    dealt = sharding.shard_numbering(placed, SHARD_SIZE, digits=7)
    path = fresh_path(spark, label)
    features.write_features(
        dealt.select("shard_no", "shard_pos", F.col("shard_key").alias("key"), F.col("bucket").alias("ratio"), "latent"), path
    )
    return spark.read.schema("shard_no long, key string, latent array<int>, ratio double").parquet(path)


@query(
    "feature_batches",
    f"""WITH {BUCKETED_SQL},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY shard_idx, pos) - 1 AS i,
         count(*) OVER (PARTITION BY bucket) AS n FROM bucketed_v)
SELECT round(bucket, 6) AS ratio, i // 8 AS batch_no, i % 8 AS slot, length(caption) AS latent0
FROM numbered WHERE i // 8 < n // 8""",
)
def feature_batches(spark, sf_dir):
    """Batches from a feature table written in shards."""
    rows = written_features(spark, sf_dir, "features-batched")
    keyed = rows.withColumn("shard_pos", F.col("key").cast("long"))
    return training.feature_batches(keyed, BATCH).select(
        F.round("ratio", 6).alias("ratio"), "batch_no", "slot", F.col("latent")[0].alias("latent0")
    )


@query(
    "feature_cache",
    f"""WITH {SAMPLES_SQL}
SELECT key, CASE WHEN doc_id IS NULL THEN 'second' ELSE 'first' END AS run, length(caption) AS latent
FROM samples_v LEFT JOIN labels ON pos = doc_id""",
)
def feature_cache(spark, sf_dir):
    """The labelled documents are encoded first; the second run adds the others only."""
    rows = samples(spark, sf_dir).select("key", "pos", "caption")
    labelled = rows.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos")), "pos", "left_semi")
    path = fresh_path(spark, "cache")
    schema = "key string, run string, latent int, _error string"

    def encode(run):
        return lambda misses: misses.select(
            "key", F.lit(run).alias("run"), F.length("caption").alias("latent"), F.lit(None).cast("string").alias("_error")
        )

    features.refresh_cache(spark, labelled, path, schema, ["key"], encode("first"))
    return features.refresh_cache(spark, rows, path, schema, ["key"], encode("second")).drop("_error")


@query(
    "read_through",
    f"""WITH {SAMPLES_SQL}
SELECT key, CASE WHEN doc_id IS NULL THEN 'encoded' ELSE 'cached' END AS origin FROM samples_v LEFT JOIN labels ON pos = doc_id""",
)
def read_through(spark, sf_dir):
    cache = table(spark, sf_dir, "labels").select(F.format_string("%09d", "doc_id").alias("key"), F.lit("cached").alias("origin"))
    return features.read_through(
        samples(spark, sf_dir).select("key"), cache, ["key"], lambda misses: misses.withColumn("origin", F.lit("encoded"))
    )


def caption_shards(spark, sf_dir):
    """Caption shards beside ``image_shards``: JSON for labelled documents, drafts first."""
    dealt = sharding.shard_numbering(samples(spark, sf_dir).drop("caption"), SHARD_SIZE)
    drafts = captions(spark, sf_dir).withColumnRenamed("doc_id", "pos2")
    said = dealt.join(drafts.withColumnRenamed("pos", "draft"), dealt["pos"] == drafts["pos2"])
    json = F.to_json(F.struct(F.col("shard_key").alias("key"), F.col("caption").alias("sharecap_caption")))
    rows = said.select(
        "shard_no",
        (F.col("shard_pos") * 2 + F.col("draft")).alias("shard_pos"),
        F.format_string("c%06d-%d", F.col("shard_pos"), F.col("draft")).alias("shard_key"),
        json.alias("json"),
    )
    path = fresh_path(spark, "tar-captions")
    tar.write_shards(tar.by_shard(rows), path, ["json"])
    return path


@query(
    "build_captioned",
    f"""WITH {SMALL_SQL}, {CAPTIONS_SQL},
best AS (SELECT doc_id, max_by(caption, pos) AS txt FROM captions_v GROUP BY doc_id),
kept AS (
  SELECT s.*, txt, row_number() OVER (ORDER BY s.i) - 1 AS j FROM small_v s JOIN best ON s.pos = best.doc_id)
SELECT j // 50 AS shard_idx, printf('%06d', i % 64) AS key, txt AS caption, h AS height, w AS width FROM kept""",
)
def build_captioned(spark, sf_dir):
    """Image shards joined with caption shards into new shards."""
    path = fresh_path(spark, "tar-captioned")
    sources = image_shards(spark, sf_dir, "tar-images"), caption_shards(spark, sf_dir)
    # Every image shard has a caption shard as long as its documents include a label.
    dataset.build_captioned(spark, *sources, path, 50, image="png")
    back = tar.tar_scan(spark, path, fields=["txt"], sizes=True)
    return back.select("shard_idx", "key", fields.text_field(F.col("fields")).alias("caption"), "height", "width")


def toy_image_model():
    """A toy image encoder on normalised input: the size of its input."""
    return lambda pictures: [[float(p.shape[1]), float(p.shape[2])] for p in pictures]


PRECOMPUTED_SQL = f"""{PLACED_SQL},
dealt_f AS (SELECT *, row_number() OVER (ORDER BY i // 64, i % 64) - 1 AS f FROM full_v)"""


@query(
    "precompute_features",
    f"""WITH {PRECOMPUTED_SQL}
SELECT f // 100 AS shard_no, printf('%07d', f % 100) AS key, round(bucket, 6) AS ratio,
       th::DOUBLE AS height, tw::DOUBLE AS width, len(string_split(caption, ' ')) AS words FROM dealt_f""",
)
def precompute_features(spark, sf_dir):
    path = fresh_path(spark, "precomputed")
    shards = image_shards(spark, sf_dir, "tar-encode")
    precompute.precompute_features(spark, shards, path, SMALL_BINS, toy_image_model, word_lengths, BATCH, 100)
    rows = spark.read.schema("shard_no long, key string, latent array<float>, emb array<array<float>>, ratio double").parquet(path)
    return rows.select(
        "shard_no",
        "key",
        F.round("ratio", 6).alias("ratio"),
        F.col("latent")[0].cast("double").alias("height"),
        F.col("latent")[1].cast("double").alias("width"),
        F.size("emb").cast("long").alias("words"),
    )


EMITTED_SQL = f"""{PLACED_SQL},
emitted_b AS (
  SELECT bucket, j // 8 AS batch_no, row_number() OVER (ORDER BY max(i)) - 1 AS e FROM full_v GROUP BY ALL),
emitted_f AS (SELECT v.*, e * 8 + j % 8 AS f FROM full_v v JOIN emitted_b b ON v.bucket = b.bucket AND v.j // 8 = b.batch_no)"""
FEATURES = "shard_no long, key string, latent array<float>, emb array<array<float>>, ratio double"


def feature_rows(rows):
    return rows.select(
        "shard_no",
        "key",
        F.round("ratio", 6).alias("ratio"),
        F.col("latent")[0].cast("double").alias("height"),
        F.col("latent")[1].cast("double").alias("width"),
        F.size("emb").cast("long").alias("words"),
    )


@query(
    "precompute_emission",
    f"""WITH {EMITTED_SQL}
SELECT f // 100 AS shard_no, printf('%07d', f % 100) AS key, round(bucket, 6) AS ratio,
       th::DOUBLE AS height, tw::DOUBLE AS width, len(string_split(caption, ' ')) AS words FROM emitted_f""",
)
def precompute_emission(spark, sf_dir):
    """Features numbered as their batches fill up; the task that encodes a feature shard writes it."""
    path = fresh_path(spark, "emitted")
    shards = image_shards(spark, sf_dir, "tar-emit")
    precompute.precompute_features(spark, shards, path, SMALL_BINS, toy_image_model, word_lengths, BATCH, 100, emission_order=True)
    return feature_rows(spark.read.schema(FEATURES).parquet(path))


@query(
    "precompute_cached",
    f"""WITH {EMITTED_SQL}
SELECT f // 100 AS shard_no, printf('%07d', f % 100) AS key, round(bucket, 6) AS ratio,
       th::DOUBLE AS height, tw::DOUBLE AS width, len(string_split(caption, ' ')) AS words, 0 AS encoded_again FROM emitted_f""",
)
def precompute_cached(spark, sf_dir):
    """The same through the feature cache; the second run, whose rows are returned, encodes nothing."""
    path = fresh_path(spark, "cached")
    shards = image_shards(spark, sf_dir, "tar-cached")

    def run(name):
        return precompute.precompute_features(
            spark, shards, f"{path}/{name}", SMALL_BINS, toy_image_model, word_lengths, BATCH, 100, emission_order=True, cache_path=f"{path}/cache"
        )

    run("first")
    again = run("second")
    return feature_rows(spark.read.schema(FEATURES).parquet(f"{path}/second")).withColumn("encoded_again", F.lit(again))


@query(
    "training_batches",
    f"""WITH {PLACED_SQL},
n AS (SELECT (count(*) + 63) // 64 AS shards FROM small_v),
ranked AS (
  SELECT r.r AS rank, p.* FROM placed_v p, n, range(4) r(r)
  WHERE CASE WHEN shards < 4 THEN TRUE ELSE r.r = least(i // 64 // (shards // 4), 3) END),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY rank, bucket ORDER BY i) - 1 AS k,
         count(*) OVER (PARTITION BY rank, bucket) AS m FROM ranked),
shared AS (
  SELECT bucket, CASE WHEN count(DISTINCT rank) = 4 THEN min(m // 4) ELSE 0 END AS whole FROM numbered GROUP BY bucket)
SELECT rank, round(bucket, 6) AS bucket, k // 4 AS batch_no, k % 4 AS slot, i // 64 AS shard_idx,
       printf('%06d', i % 64) AS key, md5(caption) AS digest, th::DOUBLE AS height
FROM numbered JOIN shared USING (bucket) WHERE k // 4 < whole""",
)
def training_batches(spark, sf_dir):
    """Batches for four ranks from image shards."""
    shards = image_shards(spark, sf_dir, "tar-train")
    rows = training.training_batches(spark, shards, SMALL_BINS, RANKS, 4, toy_image_model, word_lengths, 3, 2)
    return rows.select(
        "rank",
        F.round("bucket", 6).alias("bucket"),
        "batch_no",
        "slot",
        "shard_idx",
        "key",
        F.md5(F.encode("caption", "UTF-8")).alias("digest"),
        F.col("latent")[0].cast("double").alias("height"),
    )


@query(
    "precompute_quarantine",
    f"""WITH {SMALL_SQL}
SELECT CASE WHEN pos % 7 = 0 THEN 'header' WHEN pos % 13 = 0 THEN 'caption' WHEN pos % 11 = 0 THEN 'body' ELSE 'good' END AS kind,
       count(*) AS rows FROM small_v GROUP BY ALL""",
)
def precompute_quarantine(spark, sf_dir):
    """Images cut off in the header or the body, and captions that are no text: the job goes on and tells each kind."""
    cut = "CASE WHEN pos % 7 = 0 THEN substring(png, 1, 10) WHEN pos % 11 = 0 THEN substring(png, 1, 40) ELSE png END"
    text = "CASE WHEN pos % 13 = 0 THEN X'61FF62' ELSE encode(caption, 'UTF-8') END"
    shards = image_shards(spark, sf_dir, "tar-quarantine", png=cut, txt=text)
    path = fresh_path(spark, "quarantine")
    precompute.precompute_features(spark, shards, path, SMALL_BINS, toy_image_model, word_lengths, 1, 100)
    rows = spark.read.schema("latent array<float>, _error string, ratio double").parquet(path)
    kind = F.when(F.col("_error").isNull(), "good").when(F.col("_error").contains("caption"), "caption").otherwise("body")
    rejected = precompute.rejected_samples(spark, shards, precompute.nearest(SMALL_BINS, limit=100.0, fallback=0.6))
    kinds = rows.select(kind.alias("kind")).unionByName(rejected.select(F.lit("header").alias("kind")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "training_epochs",
    f"""WITH {PLACED_SQL},
n AS (SELECT (count(*) + 63) // 64 AS shards FROM small_v),
ranked AS (
  SELECT r.r AS rank, e.e AS epoch, p.* FROM placed_v p, n, range(4) r(r), range(3) e(e)
  WHERE CASE WHEN shards < 4 THEN TRUE ELSE r.r = least(i // 64 // (shards // 4), 3) END),
numbered AS (
  SELECT rank, bucket, count(*) AS m FROM ranked GROUP BY ALL),
shared AS (
  SELECT bucket, CASE WHEN count(DISTINCT rank) = 4 THEN min(m // 4) ELSE 0 END AS whole FROM numbered GROUP BY bucket),
names AS (SELECT bucket, unnest(range(whole)) AS batch_no FROM shared)
SELECT count(*) AS batches, least(count(*), 40) * 4 * 4 AS rows, least(count(*), 40) AS steps FROM names""",
)
def training_epochs(spark, sf_dir):
    """Three shuffled epochs, of which twenty steps of two batches are kept."""
    shards = image_shards(spark, sf_dir, "tar-epochs")
    index = training.rank_index(spark, shards, RANKS, precompute.nearest(SMALL_BINS))
    whole = training.planned_batches(index, RANKS, 4, epochs=3, seed=9)
    kept = training.planned_batches(index, RANKS, 4, epochs=3, seed=9, steps=20, accumulation=2)
    names = whole.filter("rank = 0 AND slot = 0").agg(F.count(F.lit(1)).alias("batches"))
    return names.crossJoin(kept.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("batch_seq").alias("steps")))
