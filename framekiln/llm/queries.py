"""One query per operator over the given tables, each beside its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framekiln.llm import lm, negatives, packing, pii, quality, quotations, reputation, simhash, suffixes, toxicity, vectors, whitening, winnowing
from framekiln.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


# For conversations without quotations, as in the given tables; quotations are tested on fixtures.
_OP1 = r"""
SELECT conv_id, turn, role,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position,
  lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS reply_turn,
  min(turn) OVER (PARTITION BY conv_id) AS branch,
  CAST(0 AS BIGINT) AS n_quotes, CAST(0 AS BIGINT) AS n_linked,
  array_to_string(list_filter(string_split_regex(text, '\r?\n'), lambda x: NOT regexp_matches(x, '^[ \t]*>')), chr(10)) AS text
FROM conversations
"""


@query("op1_quotations", _OP1)
def op1_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of every conversation without quotations, in the order of replies."""
    return quotations.reply_ordered(table(spark, sf_dir, "conversations"))


@query("op2_suffixes")
def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur again, in any document."""
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


@query("op3_lm")
def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under a model of nine tenths of them."""
    return lm.scored(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels outside the held-out quarter."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: exact spans and those that the trees add."""
    return pii.detect(table(spark, sf_dir, "documents"))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles and their groups within 3 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", text.alias("fingerprint"), "component_id")


_OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a),
m AS (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM e WHERE e.a = m.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM m
"""


@query("op8_vectors", _OP8)
def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of equal label with a cosine of 0.93 or more, and their groups."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 1024 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


_OP10 = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bl) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, n, i FROM dw JOIN bw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op10_winnowing", _OP10)
def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside any window of 10 words of a benchmark item."""
    return winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labels outside the held-out fifth."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_OP11 = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
o AS (SELECT doc_id AS page_id, max(quality = 0 OR toxic = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
h AS (
  SELECT host, split_part(host, '.', -1) AS suffix, array_to_string(string_split(host, '.')[-2:], '.') AS domain,
    count(bad) AS n, count(*) FILTER (WHERE bad) AS bad FROM p LEFT JOIN o USING (page_id) GROUP BY 1),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (1 + sum(sum(bad)) OVER () - sum(bad)) / (2 + sum(sum(n)) OVER () - sum(n)) AS m FROM h GROUP BY 1),
s1 AS (SELECT 1 / least(0.5, greatest(0.001, coalesce(sum((bad - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.5))) - 1 AS w FROM s0),
s AS (SELECT suffix, w * m + bad AS bad_above, w + n AS n_above FROM s0, s1),
d00 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2),
d0 AS (SELECT domain, n, bad, (bad_above - bad) / (n_above - n) AS m FROM d00 JOIN s USING (suffix)),
d1 AS (SELECT 1 / least(0.5, greatest(0.001, coalesce(sum((bad - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.5))) - 1 AS w FROM d0),
d AS (SELECT domain, w * m + bad AS bad_above, w + n AS n_above FROM d0, d1),
h0 AS (SELECT host, n, bad, (bad_above - bad) / (n_above - n) AS m FROM h JOIN d USING (domain)),
h1 AS (SELECT 1 / least(0.5, greatest(0.001, coalesce(sum((bad - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.5))) - 1 AS w FROM h0),
h2 AS (SELECT host, n, bad, (w * m + bad) / (w + n) AS mean, w FROM h0, h1),
b AS (SELECT host, n, bad, mean - 1.645 * sqrt(mean * (1 - mean) / (w + n + 1)) AS bound FROM h2),
r AS (
  SELECT page_id, host, path, n, bad, bound, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p JOIN b USING (host))
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow'
    WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END END AS verdict, n AS n_labelled, bad AS n_bad
FROM r
"""


@query("op11_reputation", _OP11)
def op11_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url by rules and its host's reputation; a page's outcome is the label of its id."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.expr("quality = 0 OR toxic = 1").alias("bad"))
    return reputation.judge(table(spark, sf_dir, "pages"), outcomes).drop("bound")


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened leading components of every vector."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


_OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query("op12_negatives", _OP12)
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", shifted)
    return negatives.mined(rows, F.col("vec_id") % 100 == 0)
