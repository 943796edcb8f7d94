"""Toxicity from the nearest labelled examples under exact TF-IDF cosine.

At most about ``EXAMPLES`` labelled documents, drawn by a hash of their id, are the examples. The
vocabulary is the ``TERMS`` words and word beginnings that stand out most in toxic examples (likelihood ratio) and occur in a
fair share of them. The examples' unit vectors form an inverted index: postings by term, cut into blocks of
``BLOCK`` examples, with the largest weight of each term and block. A query adds up these maxima to
bounds by block, visits blocks from the highest bound, and ends when no bound reaches the k-th
best cosine: the neighbours are exact. Their labels are weighted by distance, a document's own example left out
while calibrating; monotone steps fitted on examples that took no part in choosing words turn votes into
probabilities. The neighbours' ids are returned as evidence.

The index has at most EXAMPLES x TERMS postings, so its size is bounded whatever the corpus; documents are
scored in one pass over whole texts without a shuffle.

Cases: a text without any word of the vocabulary (also a null or empty one) gets the rate of
such examples and has no evidence; examples of equal text are one example with their mean label; of
several labels of one document the largest counts, null labels are left out; rows without ``doc_id`` are
scored; without labels the score is 0; equally near neighbours are taken in the index's order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framekiln.llm.common import MARKS, Tokens, chunks, fold, isotonic, received, send, texts_of
from framekiln.session import written

EXAMPLES = 16_384
TERMS = 512
SHARE = 0.004
BLOCK = 64
NEIGHBOURS = 15
THRESHOLD = 0.3
MEMORY = 50_000
# Beginnings of longer words stand for their stems.
BEGINNINGS = (5, 6, 7, 8)


def term_counts(texts: list[bytes], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of every different term of every text, or of those in ``only`` (sorted)."""
    tokens = Tokens(texts, MARKS)
    parts = [(tokens.doc, tokens.hash), *(tokens.beginnings(n) for n in BEGINNINGS)]
    if only is not None:
        parts = [(doc[hit], term[hit]) for doc, term in parts for hit in [_among(term, only)]]
    doc, term = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (term[1:] != term[:-1]))) if len(doc) else np.zeros(0, np.int64)
    return doc[new], term[new], np.diff(np.append(new, len(doc)))


def _among(term: np.ndarray, only: np.ndarray) -> np.ndarray:
    if not len(only):
        return np.zeros(0, np.int64)
    low = np.zeros(1 << 16, bool)
    low[only & np.uint64(0xFFFF)] = True
    maybe = np.flatnonzero(low[term & np.uint64(0xFFFF)])
    at = np.minimum(np.searchsorted(only, term[maybe]), len(only) - 1)
    return maybe[only[at] == term[maybe]]


class BlockMaxIndex:
    """Unit vectors of examples by term, with the largest weight in each block."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, examples: int, terms: int) -> None:
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        self.blocks = max(1, -(-examples // BLOCK))
        key = term[order] * self.blocks + self.example // BLOCK
        self.begin = np.searchsorted(key, np.arange(terms * self.blocks + 1))
        self.top = np.zeros(terms * self.blocks)
        np.maximum.at(self.top, key, self.weight)
        self.top = self.top.reshape(terms, self.blocks)

    def nearest(self, term: np.ndarray, weight: np.ndarray, count: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``count`` examples with the largest cosine above 0, ties by number, and their cosines."""
        bound = weight @ self.top[term]
        order = np.argsort(-bound, kind="stable")
        best, cosine = np.zeros(0, np.int64), np.zeros(0)
        for block in order.tolist():
            if bound[block] <= 0 or (len(best) == count and bound[block] < cosine[-1] - 1e-12):
                break
            score = np.zeros(BLOCK)
            for t, w in zip(term.tolist(), weight.tolist()):
                a, b = self.begin[t * self.blocks + block], self.begin[t * self.blocks + block + 1]
                if a < b:
                    score[self.example[a:b] - block * BLOCK] += w * self.weight[a:b]
            found = np.flatnonzero(score > 0)
            number = found + block * BLOCK
            fresh = number != without
            best, cosine = np.append(best, number[fresh]), np.append(cosine, score[found][fresh])
            keep = np.lexsort((best, -np.round(cosine, 12)))[:count]
            best, cosine = best[keep], cosine[keep]
        return best, cosine


class Model:
    """Vocabulary, index, labels of the examples and calibration."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, example: np.ndarray, term: np.ndarray, times: np.ndarray, label: np.ndarray, ids: list) -> None:
        by_hash = np.argsort(terms)
        self.terms, self.idf = terms[by_hash], idf[by_hash]
        weight = (1 + np.log(times)) * self.idf[self._known(term)[1]] if len(term) else np.zeros(0)
        norm = np.sqrt(np.bincount(example, weight**2, len(label)))
        # Examples that share their heaviest word lie in the same blocks, which keeps the bounds tight.
        heaviest = np.full(len(label), -1)
        rank = np.argsort(weight)
        number = self._known(term)[1] if len(term) else np.zeros(0, np.int64)
        heaviest[example[rank]] = number[rank]
        order = np.lexsort((np.arange(len(label)), heaviest))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.place = place
        self.label, self.ids = label[order], [ids[i] for i in order]
        self.prior = float(label.mean()) if len(label) else 0.0
        self.index = BlockMaxIndex(place[example], number, weight / norm[example] if len(term) else weight, len(label), len(terms))
        self.empty = self.prior
        self.knots, self.levels = np.zeros(0), np.zeros(0)
        self.memory: dict = {}

    def _known(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.terms):
            return np.zeros(len(term), bool), np.zeros(len(term), np.int64)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        return self.terms[at] == term, at

    def vectors(self, doc: np.ndarray, term: np.ndarray, times: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Unit vectors of the texts that have words of the vocabulary."""
        hit, at = self._known(term)
        doc, at, times = doc[hit], at[hit], times[hit]
        cut = np.flatnonzero(np.diff(doc)) + 1
        out = {}
        for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(doc)).tolist()):
            if a < b:
                weight = (1 + np.log(times[a:b])) * self.idf[at[a:b]]
                out[int(doc[a])] = (at[a:b], weight / np.sqrt((weight**2).sum()))
        return out

    def vote(self, term: np.ndarray, weight: np.ndarray, without: int = -1) -> tuple[float, np.ndarray]:
        best, cosine = self.index.nearest(term, weight, NEIGHBOURS, without)
        near = 1 / (0.05 + np.maximum(0, 1 - cosine))
        return float(((near * self.label[best]).sum() + self.prior) / (near.sum() + 1)), best

    def calibrate(self, raw: np.ndarray, label: np.ndarray, empty: np.ndarray) -> None:
        """Steps from votes of examples with a vector, and the rate of those without."""
        self.empty = float((empty.sum() + self.prior) / (len(empty) + 1))
        if len(raw):
            knots, levels = isotonic(raw, label)
            self.knots, self.levels = knots, np.clip(levels, 0.5 / (len(raw) + 1), 1 - 0.5 / (len(raw) + 1))

    def __call__(self, vector: tuple[np.ndarray, np.ndarray] | None) -> tuple[float, list]:
        if vector is None:
            return self.empty, []
        key = (vector[0].tobytes(), vector[1].tobytes())
        known = self.memory.get(key)
        if known is None:
            raw, best = self.vote(*vector)
            score = float(np.interp(raw, self.knots, self.levels)) if len(self.knots) else raw
            known = self.memory[key] = (score, [self.ids[i] for i in best[:3]])
            if len(self.memory) > MEMORY:
                self.memory.clear()
        return known


def fit(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, examples: int = EXAMPLES) -> Model | None:
    """Model from at most about ``examples`` labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("y")).filter("y IS NOT NULL AND __id IS NOT NULL")
    known = known.groupBy("__id").agg(F.max("y").alias("y")).withColumn("fold", fold(F.col("__id"), folds)).filter(F.col("fold") != held_out)
    size = known.count()
    drawn = F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) * F.lit(float(max(size, 1))) < F.lit(float(examples) * (1 << 30))
    known = written(known.filter(drawn), "toxicity-labels")  # about ``examples`` rows at most
    joined = docs.join(F.broadcast(known), docs["doc_id"] == known["__id"]).select("doc_id", "text", "y", "fold")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            doc, term, times = term_counts(texts)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            pairs = pa.StructArray.from_arrays([pa.array(term.view(np.int64)), pa.array(times, pa.int32())], ["term", "times"])
            listed = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pairs)
            yield pa.record_batch({**{c: rows.column(c) for c in ("doc_id", "y", "fold", "key")}, "terms": listed})

    keyed = joined.withColumn("key", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    listed = keyed.mapInArrow(run, f"doc_id {kind}, y int, fold long, key long, terms array<struct<term:long,times:int>>")
    once = listed.groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.avg("y").alias("y"), F.max("fold").alias("fold"), F.first("terms").alias("terms")
    )
    once = written(once, "toxicity-examples")
    whole = once.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), F.sum((F.col("fold") != folds - 1).cast("int")).alias("m"), F.sum(F.when(F.col("fold") != folds - 1, F.col("y"))).alias("m_ones")).first()
    if not whole["n"]:
        return None
    each = once.select("doc_id", "key", "y", "fold", F.explode("terms").alias("t")).select("doc_id", "key", "y", "fold", "t.*")
    stats = each.filter(F.col("fold") != folds - 1).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"))
    m, ones = float(whole["m"] or 0), float(whole["m_ones"] or 0)

    def part(a, e):
        return F.when(a > 0, a * F.log(a / e)).otherwise(F.lit(0.0))

    n, k = F.col("n").cast("double"), F.col("ones").cast("double")
    rate = max(ones, 1e-9) / max(m, 1.0)
    ratio = 2 * (part(k, n * rate) + part(n - k, n * max(1 - rate, 1e-9)) + part(ones - k, (m - n) * rate + 1e-9) + part(m - n - ones + k, (m - n) * max(1 - rate, 1e-9) + 1e-9))
    telling = stats.withColumn("ratio", ratio).filter((k > n * rate) & (n >= F.lit(max(3.0, SHARE * m))) & (F.col("ratio") > 15.0))
    chosen = telling.orderBy(F.desc("ratio"), "term").limit(TERMS).select("term", "n").toPandas()  # TERMS rows at most
    terms, idf = chosen["term"].to_numpy(np.int64).view(np.uint64), np.log((m + 1) / (chosen["n"].to_numpy(float) + 1)) + 1

    labelled = once.select("key", "doc_id", "y", "fold").orderBy("key").toPandas()  # EXAMPLES rows at most
    number = {key: i for i, key in enumerate(labelled["key"].tolist())}
    chosen_terms = once.sparkSession.createDataFrame(chosen[["term"]].astype("int64"), "term long")
    held = each.join(F.broadcast(chosen_terms), "term").select("key", "term", "times").toPandas()
    example = np.array([number[x] for x in held["key"].tolist()], np.int64)
    label = labelled["y"].to_numpy(float)
    model = Model(terms, idf, example, held["term"].to_numpy(np.int64).view(np.uint64), held["times"].to_numpy(float), label, labelled["doc_id"].tolist())
    order = np.lexsort((held["term"].to_numpy(np.int64).view(np.uint64), example))
    vectors = model.vectors(example[order], held["term"].to_numpy(np.int64).view(np.uint64)[order], held["times"].to_numpy(float)[order])
    test = np.flatnonzero(labelled["fold"].to_numpy() == folds - 1)
    raw = [(model.vote(*vectors[i], without=int(model.place[i]))[0], label[i]) for i in test.tolist() if i in vectors]
    empty = np.array([label[i] for i in test.tolist() if i not in vectors])
    model.calibrate(np.array([r[0] for r in raw]), np.array([r[1] for r in raw]), empty)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row; the last fold calibrates."""
    picked = texts_of(docs)
    model = fit(picked, labels, folds, held_out, examples)
    shared = send(picked.sparkSession, model)  # EXAMPLES x TERMS postings at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = received(shared)
        for rows, texts in chunks(batches):
            if known is None:
                results = [(0.0, [])] * len(texts)
            else:
                vectors = known.vectors(*term_counts(texts, known.terms))
                results = [known(vectors.get(i)) for i in range(len(texts))]
            yield pa.record_batch(
                {
                    "doc_id": rows.column("doc_id"),
                    "score": pa.array([r[0] for r in results], pa.float64()),
                    "evidence": pa.array([r[1] for r in results], pa.list_(rows.column("doc_id").type)),
                }
            )

    kind = picked.schema["doc_id"].dataType.simpleString()
    scored = picked.mapInArrow(run, f"doc_id {kind}, score double, evidence array<{kind}>")
    out = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
