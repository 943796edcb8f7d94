"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's documents; all but the last return the columns of ``documents``:

1. quality: rejects documents that the quality model scores below its threshold;
2. near_duplicates: of texts whose 5-word shingles agree to 0.8 or more (over any path), and of copies, the one with the
   smallest ``doc_id`` stays;
3. decontamination: rejects documents that hold 10 consecutive words of a benchmark item;
4. pii: replaces personal data by its kind; ``n_chars`` follows;
5. packing: cuts the tokens of every document into pieces and packs them into sequences.

Null texts count as empty; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framekiln.llm import packing, pii, quality, simhash, winnowing
from framekiln.llm.common import bound_batches, table
from framekiln.session import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return simhash.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnowing.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return pii.redacted(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("packing", pack),
]

# The quality model, fingerprints by XXH64 and token ids are beyond SQL; the tests hold stages against plain rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
