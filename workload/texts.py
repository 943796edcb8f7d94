"""Caption and vector queries."""

import re

from pyspark.sql import functions as F

from framekiln.functions import captions as C
from framekiln.functions import vectors as V
from workload.registry import query
from workload.views import SAMPLES_SQL, TOKENS_SQL, samples, table, tokens

REJECT = ("the", "de", "la", "der", "que")

# ---- captions ----------------------------------------------------------------


@query(
    "phrase_join",
    f"""WITH {SAMPLES_SQL},
words AS (SELECT key, unnest(string_split(caption, ' ')) AS w, generate_subscripts(string_split(caption, ' '), 1) AS i
          FROM samples_v),
firsts AS (SELECT key, w, min(i) AS i FROM words WHERE w NOT IN ('the', 'de', 'la', 'der', 'que') GROUP BY ALL)
SELECT key, coalesce(string_agg(replace(w, 'tion', 'sks tion'), ', ' ORDER BY i), '') AS caption
FROM samples_v LEFT JOIN firsts USING (key) GROUP BY key""",
)
def phrase_join(spark, sf_dir):
    parts = F.split("caption", " ")
    return samples(spark, sf_dir).select("key", C.join_phrases(parts, "tion", "sks", REJECT).alias("caption"))


@query("class_label", f"WITH {SAMPLES_SQL} SELECT key, replace(caption, 'the', 'sks the') AS caption FROM samples_v")
def class_label(spark, sf_dir):
    return samples(spark, sf_dir).select("key", C.class_label(F.col("caption"), "the", "sks").alias("caption"))


@query("remove_word", f"WITH {SAMPLES_SQL} SELECT key, replace(caption, 'the', '') AS caption FROM samples_v")
def remove_word(spark, sf_dir):
    return samples(spark, sf_dir).select("key", C.remove_word(F.col("caption"), "the").alias("caption"))


@query(
    "caption_guard",
    """WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN t = '' THEN '' ELSE 'photo, ' || t END AS caption FROM c""",
)
def caption_guard(spark, sf_dir):
    text = F.when(F.pmod("turn", F.lit(3)) == 0, F.lit("")).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("t"))
    edited = F.concat(F.lit("photo, "), F.col("t"))
    return rows.select("conv_id", "turn", C.caption_guard(F.col("t"), edited).alias("caption"))


def word_tagger():
    """A rule that stands in for a language model, so that SQL can follow it.

    Words ending in e are adjectives and those in s, n or t nouns; other words are
    neither. Two capitalised words in a row are a person.
    """
    word = re.compile("[A-Za-z]+")
    name = re.compile("[A-Z][a-z]+ [A-Z][a-z]+")
    kinds = {"e": "ADJ", "s": "NOUN", "n": "NOUN", "t": "PROPN"}

    def tag(caption):
        words = word.findall(caption)
        names = name.findall(caption)
        return words, [kinds.get(w[-1].lower(), "X") for w in words], names, ["PERSON"] * len(names)

    return tag


def nameless_tagger():
    tag = word_tagger()
    return lambda caption: (*tag(caption)[:2], [], [])


TAGS_SQL = f"""{SAMPLES_SQL},
found AS (SELECT key, regexp_extract_all(caption, '[A-Za-z]+') AS ws FROM samples_v),
tagged AS (
  SELECT key, i, lower(w) AS w,
         CASE lower(right(w, 1)) WHEN 'e' THEN 'ADJ' WHEN 's' THEN 'NOUN' WHEN 'n' THEN 'NOUN' WHEN 't' THEN 'PROPN'
              ELSE 'X' END AS pos
  FROM (SELECT key, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM found))"""


@query(
    "tag_tokens",
    f"""WITH {TAGS_SQL}
SELECT key, pos, count(*) AS words, sum(length(w))::BIGINT AS letters FROM tagged GROUP BY ALL""",
)
def tag_tokens(spark, sf_dir):
    rows = samples(spark, sf_dir).select("key", C.tag_tokens(word_tagger)(F.col("caption")).alias("tagged"))
    pairs = F.arrays_zip("tagged.tags", "tagged.words")
    words = rows.select("key", F.explode(pairs).alias("t")).select("key", F.col("t.tags").alias("pos"), "t.words")
    return words.groupBy("key", "pos").agg(
        F.count(F.lit(1)).alias("words"), F.sum(F.length("words")).alias("letters")
    )


@query(
    "compress_caption",
    f"""WITH {TAGS_SQL},
nouns AS (
  SELECT *, count(*) FILTER (WHERE pos IN ('NOUN', 'PROPN')) OVER (PARTITION BY key ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM tagged WHERE pos <> 'X'),
phrases AS (
  SELECT key, before, string_agg(w, ' ' ORDER BY i) AS p FROM nouns
  GROUP BY key, before HAVING bool_or(pos <> 'ADJ')),
firsts AS (SELECT key, p, min(before) AS place FROM phrases WHERE p NOT IN ('the', 'de', 'la', 'der', 'que') GROUP BY ALL)
SELECT key, coalesce(string_agg(p, ', ' ORDER BY place), '') AS caption
FROM samples_v LEFT JOIN firsts USING (key) GROUP BY key""",
)
def compress_caption(spark, sf_dir):
    rows = samples(spark, sf_dir).select("key", C.tag_tokens(nameless_tagger)(F.col("caption")).alias("tagged"))
    return rows.select("key", C.compress_caption(F.col("tagged"), rejected=REJECT).alias("caption"))


@query("compress_caption_names")
def compress_caption_names(spark, sf_dir):
    rows = samples(spark, sf_dir).select("key", C.tag_tokens(word_tagger)(F.col("caption")).alias("tagged"))
    return rows.select("key", C.compress_caption(F.col("tagged"), "tion", "sks", REJECT).alias("caption"))


# ---- vectors -----------------------------------------------------------------


@query(
    "pad_mask",
    f"""WITH {TOKENS_SQL},
seqs AS (SELECT DISTINCT seq_id, n, l.l AS length FROM tokens_v, (VALUES (4), (8)) l(l)),
places AS (SELECT seq_id, n, length, unnest(range(1, length + 1)) AS i FROM seqs)
SELECT p.seq_id, p.length, p.i, coalesce(t.x, 0.0) AS x, CASE WHEN p.i <= p.n THEN 1 ELSE 0 END AS m
FROM places p LEFT JOIN tokens_v t ON t.seq_id = p.seq_id AND t.i = p.i""",
)
def pad_mask(spark, sf_dir):
    rows = tokens(spark, sf_dir)
    out = []
    for length in (4, 8):
        padded = V.pad(F.col("xs"), length, F.lit(0.0))
        both = F.arrays_zip(padded.alias("x"), V.mask(F.col("xs"), length).alias("m"))
        out.append(
            rows.select("seq_id", F.lit(length).alias("length"), F.posexplode(both).alias("i", "v")).select(
                "seq_id", "length", (F.col("i") + 1).alias("i"), F.col("v")["x"].alias("x"), F.col("v")["m"].alias("m")
            )
        )
    return out[0].unionByName(out[1])


@query("mask_trim", f"WITH {TOKENS_SQL} SELECT seq_id, i, x FROM tokens_v")
def mask_trim(spark, sf_dir):
    xs = F.col("xs")
    padded = tokens(spark, sf_dir).select("seq_id", V.pad(xs, 32, F.lit(0.0)).alias("p"), V.mask(xs, 32).alias("m"))
    trimmed = V.mask_trim(F.col("p"), F.col("m"))
    return padded.select("seq_id", F.posexplode(trimmed).alias("i", "x")).withColumn("i", F.col("i") + 1)


@query(
    "head_tail",
    """WITH x AS (SELECT vec_id, list_concat(embedding[1:1], embedding[-7:]) AS v FROM embeddings)
SELECT vec_id, unnest(range(8)) AS i, unnest(v)::DOUBLE AS x FROM x""",
)
def head_tail(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.posexplode(V.head_tail(F.col("embedding"), 8)).alias("i", "x")).withColumn(
        "x", F.col("x").cast("double")
    )


def long_vectors(spark, sf_dir, vector, *others):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", *others, F.posexplode(vector).alias("i", "x")).withColumn("x", F.round("x", 6))


ELEMENTS_SQL = """e AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"""


@query(
    "vector_affine",
    f"""WITH {ELEMENTS_SQL}
SELECT vec_id, i, round(x * 0.18215, 6) AS scaled, round((x - 0.0609) * 1.5305, 6) AS shifted FROM e""",
)
def vector_affine(spark, sf_dir):
    x = F.col("embedding").cast("array<double>")
    both = F.arrays_zip(V.scale(x, 0.18215).alias("a"), V.shift_scale(x, 0.0609, 1.5305).alias("b"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(both).alias("i", "v"))
    return rows.select("vec_id", "i", F.round("v.a", 6).alias("scaled"), F.round("v.b", 6).alias("shifted"))


@query(
    "vector_standardise",
    f"""WITH {ELEMENTS_SQL},
stats AS (SELECT label, i, avg(x) AS m, avg(x * x) - avg(x) * avg(x) AS v FROM e GROUP BY ALL)
SELECT vec_id, i, round((x - m) / sqrt(v + 0.0001), 4) AS x FROM e JOIN stats USING (label, i)""",
)
def vector_standardise(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    squares = F.transform("embedding", lambda v: v * v)
    means = V.mean_pool(rows, ["label"], out="mean")
    seconds = V.mean_pool(rows.withColumn("embedding", squares), ["label"], out="second")
    stats = means.join(seconds, "label").select(
        "label", "mean", F.zip_with("second", "mean", lambda s, m: s - m * m).alias("variance")
    )
    scaled = V.standardise(F.col("embedding"), F.col("mean"), F.col("variance"), 0.0001)
    return rows.join(stats, "label").select("vec_id", F.posexplode(scaled).alias("i", "x")).withColumn("x", F.round("x", 4))


@query(
    "pixel_normalise",
    f"""WITH {ELEMENTS_SQL},
n AS (SELECT vec_id, i, (abs(x) * 255 / 255 - 0.5) / 0.5 AS y FROM e)
SELECT vec_id, i, round(y, 6) AS unit,
       round(((y + 1) / 2 - [0.485, 0.456, 0.406, 0.5][i // 16 + 1]) / [0.229, 0.224, 0.225, 0.25][i // 16 + 1], 6) AS x
FROM n""",
)
def pixel_normalise(spark, sf_dir):
    pixels = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.abs(v) * 255)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.pixel_normalise(pixels).alias("y"))
    # Four channels of 16 values each.
    channels = V.channel_standardise(V.pixel_unit(F.col("y")), 16, (0.485, 0.456, 0.406, 0.5), (0.229, 0.224, 0.225, 0.25))
    both = rows.select("vec_id", F.posexplode(F.arrays_zip(F.col("y"), channels.alias("x"))).alias("i", "v"))
    return both.select("vec_id", "i", F.round("v.y", 6).alias("unit"), F.round("v.x", 6).alias("x"))


@query(
    "hwc_to_chw",
    """WITH e AS (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, (j % 2) * 32 + j // 2 AS i, round(x, 6) AS x FROM e""",
)
def hwc_to_chw(spark, sf_dir):
    return long_vectors(spark, sf_dir, V.hwc_to_chw(F.col("embedding").cast("array<double>"), F.lit(4), F.lit(8), 2))


@query(
    "mean_pool",
    f"""WITH {ELEMENTS_SQL} SELECT label, i, round(avg(x), 6) AS x FROM e GROUP BY ALL""",
)
def mean_pool(spark, sf_dir):
    pooled = V.mean_pool(table(spark, sf_dir, "embeddings"), ["label"])
    return pooled.select("label", F.posexplode("pooled").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(
    "mean_tokens",
    """WITH e AS (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, j % 8 AS i, round(avg(x), 6) AS x FROM e GROUP BY ALL""",
)
def mean_tokens(spark, sf_dir):
    # Each embedding as 8 tokens of 8 values.
    pieces = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice(F.col("embedding").cast("array<double>"), t * 8 + 1, 8))
    return long_vectors(spark, sf_dir, V.mean_tokens(pieces, 8))


ALIGNMENT_SQL = f"""WITH {ELEMENTS_SQL},
z AS (SELECT label, vec_id // 20 AS part, i, avg(x) AS x FROM e GROUP BY ALL),
f AS (SELECT label, i, avg(x) AS y FROM e GROUP BY ALL),
d AS (SELECT label, part, avg((x - y) * (x - y)) AS err FROM z JOIN f USING (label, i) GROUP BY ALL)"""


def alignment(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("part", F.floor(F.col("vec_id") / 20))
    pooled = V.mean_pool(rows, ["label", "part"])
    targets = V.mean_pool(rows, ["label"], out="target")
    return V.alignment_error(pooled, targets, "label", module="label")


@query("alignment_mse", f"{ALIGNMENT_SQL} SELECT label, round(avg(err), 6) AS error FROM d GROUP BY label")
def alignment_mse(spark, sf_dir):
    return alignment(spark, sf_dir).withColumn("error", F.round("error", 6))


@query(
    "alignment_loss",
    f"{ALIGNMENT_SQL}, m AS (SELECT label, avg(err) AS error FROM d GROUP BY label) SELECT round(avg(error), 6) AS loss FROM m",
)
def alignment_loss(spark, sf_dir):
    return V.mean_alignment(alignment(spark, sf_dir)).withColumn("loss", F.round("loss", 6))
