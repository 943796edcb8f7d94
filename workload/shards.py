"""Fields, shards, ranks, orders and mixes."""

from pyspark.sql import functions as F

from framekiln.functions import fields
from framekiln.operators import features, pairing, sampling, sharding
from framekiln.operators.numbering import with_ordinal
from workload.registry import query
from workload.views import (
    BINS,
    BUCKETED_SQL,
    CAPTIONS_SQL,
    RANKS,
    SAMPLES_SQL,
    bucketed,
    captions,
    draw_sql,
    samples,
    table,
)
from framekiln.operators.buckets import target_size

SHARD_SIZE = 64

DEALT_SQL = f"""{SAMPLES_SQL},
dealt_v AS (SELECT *, row_number() OVER (ORDER BY shard_idx, pos) - 1 AS i, count(*) OVER () AS n FROM samples_v)"""


@query("project_fields", f"WITH {SAMPLES_SQL} SELECT key, caption FROM samples_v")
def project_fields(spark, sf_dir):
    return fields.project_fields(samples(spark, sf_dir), ["key", "caption"])


@query(
    "first_present",
    f"""WITH {SAMPLES_SQL}
SELECT key, CASE pos % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'png' ELSE 'jpg' END AS ext,
       md5(CASE pos % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'png' ELSE 'jpg' END || caption) AS digest
FROM samples_v""",
)
def first_present(spark, sf_dir):
    rows = samples(spark, sf_dir)
    kind = F.pmod("pos", F.lit(4))

    def body(ext):
        return F.encode(F.concat(F.lit(ext), F.col("caption")), "UTF-8")

    # Kind 3 has both a png and a jpg.
    members = F.map_from_entries(
        F.filter(
            F.array(
                F.when(kind.isin(2, 3), F.struct(F.lit("png").alias("ext"), body("png").alias("data"))),
                F.when(kind == 1, F.struct(F.lit("jpeg").alias("ext"), body("jpeg").alias("data"))),
                F.when(kind.isin(0, 3), F.struct(F.lit("jpg").alias("ext"), body("jpg").alias("data"))),
            ),
            lambda e: e.isNotNull(),
        )
    )
    packed = rows.select("key", members.alias("fields"))
    return packed.select(
        "key",
        fields.first_extension(F.col("fields")).alias("ext"),
        F.md5(fields.first_present(F.col("fields"))).alias("digest"),
    )


@query(
    "required_fields",
    f"""WITH {SAMPLES_SQL}, {CAPTIONS_SQL}
SELECT DISTINCT key FROM samples_v JOIN captions_v ON samples_v.pos = captions_v.doc_id WHERE samples_v.pos % 5 <> 0""",
)
def required_fields(spark, sf_dir):
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), F.lit("said").alias("txt"))
    rows = samples(spark, sf_dir).join(labelled, "pos", "left")
    rows = rows.withColumn("image", F.when(F.pmod("pos", F.lit(5)) != 0, F.col("key")))
    return fields.required_fields(rows, ["image", "txt"]).select("key")


@query(
    "patch_grid",
    f"""WITH {BUCKETED_SQL}
SELECT key, target_height // 16 AS grid_h, target_width // 16 AS grid_w FROM bucketed_v""",
)
def patch_grid(spark, sf_dir):
    rows = target_size(bucketed(spark, sf_dir), BINS)
    return rows.select("key", fields.patch_grid(F.col("target_height"), F.col("target_width")).alias("g")).select("key", "g.*")


@query(
    "size_condition",
    f"""WITH {BUCKETED_SQL},
v AS (SELECT key, [target_height, target_width, 0, 0, target_height // 8, target_width // 8] AS x FROM bucketed_v)
SELECT key, unnest(range(6)) AS i, unnest(x) AS value FROM v""",
)
def size_condition(spark, sf_dir):
    rows = target_size(bucketed(spark, sf_dir), BINS)
    latent = [F.floor(F.col(c) / 8).cast("int") for c in ("target_height", "target_width")]
    vector = fields.size_condition(F.col("target_height"), F.col("target_width"), *latent)
    return rows.select("key", F.posexplode(vector).alias("i", "value"))


@query(
    "rekey",
    f"""WITH {DEALT_SQL}
SELECT key, printf('%06d', i % 64) AS image_key, printf('%07d', i % 64) AS feature_key FROM dealt_v""",
)
def rekey(spark, sf_dir):
    dealt = sharding.shard_numbering(samples(spark, sf_dir).select("key", "shard_idx", "pos"), SHARD_SIZE)
    return dealt.select(
        "key", F.col("shard_key").alias("image_key"), fields.rekey(F.col("shard_pos"), 7).alias("feature_key")
    )


@query(
    "caption_default",
    f"""WITH {SAMPLES_SQL}, {CAPTIONS_SQL},
best AS (SELECT doc_id, max_by(caption, pos) AS txt FROM captions_v GROUP BY doc_id)
SELECT key, coalesce(txt, CASE WHEN pos % 2 = 0 THEN 'dog' ELSE 'sks dog' END) AS caption
FROM samples_v LEFT JOIN best ON samples_v.pos = best.doc_id""",
)
def caption_default(spark, sf_dir):
    best = pairing.last_wins(captions(spark, sf_dir), ["doc_id"], "pos", "caption")
    rows = samples(spark, sf_dir).select("key", F.col("pos").alias("doc_id")).join(best, "doc_id", "left")
    is_reg = F.pmod("doc_id", F.lit(2)) == 0
    return rows.select("key", fields.caption_default(F.col("caption"), is_reg, "sks", "dog").alias("caption"))


LISTING_SQL = """files AS (
  SELECT url || CASE page_id % 6 WHEN 0 THEN '.tar' WHEN 1 THEN '.zip' WHEN 2 THEN '.txt' WHEN 3 THEN '.jpg'
                WHEN 4 THEN '.json' ELSE '.tar.gz' END AS path FROM pages)"""


@query(
    "shard_listing",
    f"""WITH {LISTING_SQL}
SELECT path FROM files WHERE path LIKE '%.tar' OR path LIKE '%.zip' OR path LIKE '%.txt' OR path LIKE '%.jpg'""",
)
def shard_listing(spark, sf_dir):
    endings = F.array(*[F.lit(e) for e in (".tar", ".zip", ".txt", ".jpg", ".json", ".tar.gz")])
    ending = F.get(endings, F.pmod("page_id", F.lit(6)).cast("int"))
    files = table(spark, sf_dir, "pages").select(F.concat("url", ending).alias("path"))
    return pairing.shard_listing(files)


@query(
    "shard_names",
    f"""WITH {DEALT_SQL}
SELECT i // 16 AS shard_no, 'set/' || printf('shard-%06d.tar', i // 16) AS shard, count(*) AS rows
FROM dealt_v GROUP BY ALL""",
)
def shard_names(spark, sf_dir):
    dealt = sharding.shard_numbering(samples(spark, sf_dir).select("shard_idx", "pos"), 16)
    counted = dealt.groupBy("shard_no").agg(F.count(F.lit(1)).alias("rows"))
    return sharding.shard_names(counted, folder="set").select("shard_no", "shard", "rows")


@query(
    "shard_numbering",
    f"""WITH {DEALT_SQL}
SELECT key, i // 64 AS shard_no, i % 64 AS shard_pos, printf('%06d', i % 64) AS shard_key FROM dealt_v""",
)
def shard_numbering(spark, sf_dir):
    dealt = sharding.shard_numbering(samples(spark, sf_dir).select("key", "shard_idx", "pos"), SHARD_SIZE)
    return dealt.select("key", "shard_no", "shard_pos", "shard_key")


@query(
    "shard_numbering_whole",
    f"""WITH {DEALT_SQL}
SELECT key, i // 64 AS shard_no, i % 64 AS shard_pos FROM dealt_v WHERE i // 64 < n // 64""",
)
def shard_numbering_whole(spark, sf_dir):
    rows = samples(spark, sf_dir).select("key", "shard_idx", "pos")
    return sharding.shard_numbering(rows, SHARD_SIZE, drop_tail=True).select("key", "shard_no", "shard_pos")


@query(
    "ordinal_sparse",
    """SELECT l_orderkey, l_linenumber,
       row_number() OVER (ORDER BY (l_orderkey * 8 + l_linenumber) * 1000003) - 1 AS ordinal FROM lineitem""",
)
def ordinal_sparse(spark, sf_dir):
    """Positions so sparse that every row is a block: the blocks are summed up in two levels."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    rows = rows.withColumn("pos", (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000003)
    return with_ordinal(rows, ["pos"], level_rows=1 << 14).drop("pos")


def _shards(spark, sf_dir, size):
    dealt = sharding.shard_numbering(samples(spark, sf_dir).select("shard_idx", "pos"), size)
    return dealt.filter("shard_pos = 0").select("shard_no")


@query(
    "rank_ranges",
    f"""WITH {DEALT_SQL},
shards AS (SELECT DISTINCT i // 16 AS shard_no, (n + 15) // 16 AS shards FROM dealt_v)
SELECT least(shard_no // (shards // 4), 3) AS rank, shard_no FROM shards""",
)
def rank_ranges(spark, sf_dir):
    return sharding.rank_ranges(_shards(spark, sf_dir, 16), RANKS).select("rank", "shard_no")


@query(
    "rank_ranges_few",
    f"""WITH {DEALT_SQL},
shards AS (SELECT DISTINCT i // 512 AS shard_no, (n + 511) // 512 AS shards FROM dealt_v)
SELECT r.r AS rank, shard_no FROM shards, range(100) r(r)
WHERE CASE WHEN shards >= 100 THEN r.r = least(shard_no // (shards // 100), 99) ELSE TRUE END""",
)
def rank_ranges_few(spark, sf_dir):
    return sharding.rank_ranges(_shards(spark, sf_dir, 512), 100).select("rank", "shard_no")


@query(
    "every_rank",
    f"""WITH {DEALT_SQL},
shards AS (SELECT DISTINCT i // 16 AS shard_no FROM dealt_v)
SELECT r.r AS rank, shard_no FROM shards, range(4) r(r)""",
)
def every_rank(spark, sf_dir):
    return sharding.every_rank(_shards(spark, sf_dir, 16), RANKS).select("rank", "shard_no")


@query("rank_round_robin", f"WITH {DEALT_SQL} SELECT key, i AS row_idx, i % 4 AS rank FROM dealt_v")
def rank_round_robin(spark, sf_dir):
    rows = samples(spark, sf_dir).select("key", "shard_idx", "pos")
    return sharding.rank_round_robin(rows, RANKS).select("key", "row_idx", "rank")


@query(
    "strided_index",
    f"""WITH {SAMPLES_SQL}
SELECT key, shard_idx % 4 AS rank,
       shard_idx % 4 + 4 * (row_number() OVER (PARTITION BY shard_idx % 4 ORDER BY shard_idx, pos) - 1) AS out_idx
FROM samples_v""",
)
def strided_index(spark, sf_dir):
    rows = samples(spark, sf_dir).select("key", "shard_idx", "pos", F.pmod("shard_idx", F.lit(RANKS)).alias("rank"))
    return sharding.strided_index(rows, RANKS).select("key", "rank", "out_idx")


@query(
    "cache_scan",
    f"""WITH {DEALT_SQL}
SELECT i AS cache_idx, key, round(sqrt(length(caption)), 6) AS latent FROM dealt_v WHERE i < 400""",
)
def cache_scan(spark, sf_dir):
    rows = sharding.rank_round_robin(samples(spark, sf_dir).select("key", "shard_idx", "pos", "caption"), RANKS)
    cache = rows.select(
        F.col("row_idx").alias("cache_idx"), "key", F.round(F.sqrt(F.length("caption")), 6).alias("latent")
    )
    return features.cache_scan(cache, 100, RANKS)


@query(
    "last_wins",
    f"WITH {CAPTIONS_SQL} SELECT doc_id, max_by(caption, pos) AS caption FROM captions_v GROUP BY doc_id",
)
def last_wins(spark, sf_dir):
    return pairing.last_wins(captions(spark, sf_dir), ["doc_id"], "pos", "caption")


@query(
    "caption_join",
    f"""WITH {SAMPLES_SQL}, {CAPTIONS_SQL},
best AS (SELECT doc_id, max_by(caption, pos) AS txt FROM captions_v GROUP BY doc_id)
SELECT shard_idx, key, txt AS caption, md5(caption) AS image FROM samples_v JOIN best ON pos = doc_id""",
)
def caption_join(spark, sf_dir):
    rows = samples(spark, sf_dir)
    images = rows.select("shard_idx", "key", F.md5("caption").alias("image"))
    # Captions of an image lie in the caption shard with the same number.
    source = table(spark, sf_dir, "documents").select(
        "doc_id", F.substring("source", 4, 9).cast("int").alias("shard_idx"), F.format_string("%09d", "doc_id").alias("key")
    )
    return pairing.caption_join(images, captions(spark, sf_dir).join(source, "doc_id")).select(
        "shard_idx", "key", "caption", "image"
    )


@query(
    "shard_pairing",
    """WITH i AS (
  SELECT row_number() OVER (ORDER BY path) - 1 AS shard_idx, path AS image_path
  FROM (SELECT url || '#' || page_id || '.tar' AS path FROM pages)),
c AS (
  SELECT row_number() OVER (ORDER BY path) - 1 AS shard_idx, path AS caption_path
  FROM (SELECT lang || '/' || doc_id || '.tar' AS path FROM documents SEMI JOIN labels USING (doc_id)))
SELECT i.shard_idx, image_path, caption_path FROM i LEFT JOIN c USING (shard_idx)""",
)
def shard_pairing(spark, sf_dir):
    images = table(spark, sf_dir, "pages").select(
        F.concat("url", F.lit("#"), F.col("page_id").cast("string"), F.lit(".tar")).alias("path")
    )
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    files = labelled.select(F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".tar")).alias("path"))
    return pairing.shard_pairing(images, files)


@query(
    "json_fields",
    "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
)
def json_fields(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return pairing.json_fields(events, F.col("props"), {"k": "bigint"}).select("event_id", "k")


@query(
    "shuffle_global",
    f"""WITH {SAMPLES_SQL}
SELECT key, row_number() OVER (ORDER BY md5(concat_ws('|', 11, 2, key)), key) - 1 AS place FROM samples_v""",
)
def shuffle_global(spark, sf_dir):
    return sampling.shuffle_global(samples(spark, sf_dir).select("key"), seed=11, epoch=2)


@query(
    "shuffle_block",
    f"""WITH {SAMPLES_SQL}
SELECT shard_idx, key,
       row_number() OVER (ORDER BY md5(concat_ws('|', 11, 0, 'shard', shard_idx)), md5(concat_ws('|', 11, 0, key)), key) - 1
         AS place FROM samples_v""",
)
def shuffle_block(spark, sf_dir):
    return sampling.shuffle_block(samples(spark, sf_dir).select("shard_idx", "key"), seed=11)


@query(
    "shuffle_buffer",
    f"""WITH {DEALT_SQL}
SELECT key, row_number() OVER (ORDER BY i + {draw_sql('11', '1', 'key')} % 100, i) - 1 AS place FROM dealt_v""",
)
def shuffle_buffer(spark, sf_dir):
    rows = samples(spark, sf_dir).select("key", "shard_idx", "pos")
    return sampling.shuffle_buffer(rows, 11, 100, epoch=1, key=["key"]).select("key", "place")


@query(
    "shard_draws",
    f"""WITH n AS (SELECT count(DISTINCT source) AS n FROM documents),
drawn AS (
  SELECT event_id % 4 AS rank, event_id // 4 AS draw, {draw_sql('(42 + event_id % 4)', '(event_id // 4)')} AS d FROM events)
SELECT rank, draw, d % n AS shard_idx FROM drawn, n""",
)
def shard_draws(spark, sf_dir):
    shards = table(spark, sf_dir, "documents").agg(F.count_distinct("source")).scalar()
    plan = table(spark, sf_dir, "events").select(
        F.pmod("event_id", F.lit(4)).alias("rank"), F.floor(F.col("event_id") / 4).alias("draw")
    )
    return plan.withColumn("shard_idx", sampling.shard_draw(42, F.col("rank"), F.col("draw"), shards))


@query(
    "epoch_cycle",
    f"""WITH {DEALT_SQL}
SELECT e.e AS epoch, key, e.e * n + i AS seq FROM dealt_v, range(3) e(e)""",
)
def epoch_cycle(spark, sf_dir):
    rows = samples(spark, sf_dir).select("key", "shard_idx", "pos")
    return sampling.epoch_cycle(rows, 3).select("epoch", "key", "seq")


@query(
    "union_sources",
    """SELECT 0 AS source_idx, p_partkey AS id, p_name AS name FROM part
UNION ALL SELECT 1, s_suppkey, s_name FROM supplier
UNION ALL SELECT 2, c_custkey, c_name FROM customer""",
)
def union_sources(spark, sf_dir):
    named = [("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name")]
    return sampling.union_sources(
        [table(spark, sf_dir, t).select(F.col(i).alias("id"), F.col(n).alias("name")) for t, i, n in named]
    ).select("source_idx", "id", "name")


@query(
    "subject_mix",
    """SELECT c.c AS cycle, FALSE AS is_reg, p.p AS pass_no, s_suppkey AS id FROM supplier, range(2) c(c), range(3) p(p)
UNION ALL SELECT c.c, TRUE, p.p, c_custkey FROM customer, range(2) c(c), range(2) p(p)""",
)
def subject_mix(spark, sf_dir):
    instances = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    others = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return sampling.subject_mix(instances, others, 3, 2, cycles=2).select("cycle", "is_reg", "pass_no", "id")


@query(
    "cache_hits_misses",
    f"""WITH {SAMPLES_SQL}
SELECT key, doc_id IS NOT NULL AND quality = 1 AS hit FROM samples_v LEFT JOIN labels ON pos = doc_id""",
)
def cache_hits_misses(spark, sf_dir):
    rows = samples(spark, sf_dir).select("key", "shard_idx", "pos")
    # Rows of low quality play corrupt cache entries.
    cache = table(spark, sf_dir, "labels").select(
        F.format_string("%09d", "doc_id").alias("key"), F.when(F.col("quality") == 0, F.lit("corrupt")).alias("_error")
    )
    hits = features.cache_hits(cache, rows, ["key"]).select("key", F.lit(True).alias("hit"))
    misses = features.cache_misses(cache, rows, ["key"]).select("key", F.lit(False).alias("hit"))
    return hits.unionByName(misses)
