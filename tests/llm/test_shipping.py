"""Operators whose workers can't import this package: the session starts elsewhere, without the repository on its path."""

import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent.parent)
CODE = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
sys.path.insert(0, {ROOT!r})
from framekiln.llm import lm, negatives, toxicity, whitening
from pyspark.sql import functions as F
docs = spark.createDataFrame([(i, f"some words {{i % 7}} of text " + ("awful" if i % 3 == 0 else "fine")) for i in range(60)], "doc_id long, text string")
labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
assert lm.scored(docs, turn_bytes=200).count() == 60
assert toxicity.toxicity(docs, labels).count() == 60
rows = spark.createDataFrame([(i, i % 2, [float(i % 5), float(i * i % 11), 1.0]) for i in range(40)], "vec_id long, label int, embedding array<float>")
assert whitening.whitened(rows).count() > 0
assert negatives.mined(rows, F.col("vec_id") % 4 == 0).count() > 0
"""


def test_without_an_installed_package():
    subprocess.run([sys.executable, "-c", CODE], cwd="/", check=True, timeout=300, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
