"""Quality scores: random Fourier features of document statistics, ridge by normal equations, isotonic steps.

One pass over whole texts turns each row into a few statistics. Standardised, they are mapped to
``FEATURES`` random cosines, whose inner products approximate a Gaussian kernel. Each partition sums
its part of the normal equations, per fold; the sums are added up in slices, so neither the driver
nor a task sees more than matrices of fixed size. Leaving out each fold in turn gives scores of rows that
the model did not see; a histogram of them is made monotone (pool adjacent violators) and maps scores to
probabilities. All labelled rows outside the held-out fold take part, whatever their number.

Cases: null and empty texts have statistics of zero and are scored like any other; a row without
``doc_id`` is scored and learns from no label; labels that are null are left out, and of several labels
of one document the largest counts; without any label every score is 0.5; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framekiln.llm.common import Tokens, chunks, fold, isotonic, mixed, texts_of
from framekiln.session import written

FEATURES = 256
RIDGE = 1e-3
THRESHOLD = 0.3
BINS = 2048
SLICES = 4

_UPPER, _LOWER, _DIGIT, _STOP, _SYMBOL, _BLANK, _OTHER = range(7)
_CLASS = np.full(256, _OTHER, np.uint8)
for _kind, _bytes in (
    (_UPPER, range(65, 91)),
    (_LOWER, range(97, 123)),
    (_DIGIT, range(48, 58)),
    (_STOP, b".,;:?'\"()-"),
    (_SYMBOL, b"!#$%&*+/<=>@[\\]^_`{|}~"),
    (_BLANK, b" \t\n\v\f\r"),
):
    _CLASS[list(_bytes)] = _kind


def _distinct(doc: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: how many different values, and how often the most frequent occurs."""
    if not len(doc):
        return np.zeros(size), np.zeros(size)
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    new = np.append(True, (np.diff(d) != 0) | (v[1:] != v[:-1]))
    runs = np.diff(np.append(np.flatnonzero(new), len(d)))
    top = np.zeros(size)
    np.maximum.at(top, d[new], runs)
    return np.bincount(d[new], minlength=size).astype(float), top


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of numbers per text, mostly shares between 0 and 1."""
    size = len(texts)
    tokens = Tokens(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begins = np.append(0, np.cumsum([len(t) + 1 for t in texts]))[:-1]
    kind = _CLASS[data]
    counts = [np.add.reduceat((kind == k).astype(np.int64), begins).astype(float) for k in range(7)]
    counts[_BLANK] -= 1
    newlines = np.add.reduceat((data == 10).astype(np.int64), begins) - 1.0
    shouts = np.add.reduceat((data == 33).astype(np.int64), begins).astype(float)
    bars = np.add.reduceat((data == 124).astype(np.int64), begins).astype(float)
    length = np.array([len(t) for t in texts], float)

    words = np.diff(tokens.first).astype(float)
    spans = (tokens.end - tokens.start).astype(float)
    per_doc = lambda x: np.bincount(tokens.doc, weights=x, minlength=size)
    kinds, top = _distinct(tokens.doc, tokens.hash, size)
    again = np.zeros(len(spans))
    if len(spans) > 1:
        again[1:] = (tokens.hash[1:] == tokens.hash[:-1]) & (tokens.doc[1:] == tokens.doc[:-1])
    last = kind[tokens.end - 1] if len(spans) else np.zeros(0)
    first = kind[tokens.start] if len(spans) else np.zeros(0)

    line_at = np.cumsum(data == 10)
    line = line_at[tokens.start]
    new = np.append(True, np.diff(line) != 0) if len(line) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    if len(heads):
        place = np.arange(len(line)) - np.repeat(heads, np.diff(np.append(heads, len(line))))
        line_hash = np.add.reduceat(mixed(tokens.hash + place.astype(np.uint64)), heads)
        line_doc = tokens.doc[heads]
    else:
        line_hash, line_doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lines = np.bincount(line_doc, minlength=size).astype(float)
    line_kinds, _ = _distinct(line_doc, line_hash, size)

    chars, w, li = np.maximum(length, 1), np.maximum(words, 1), np.maximum(lines, 1)
    letters = np.maximum(counts[_UPPER] + counts[_LOWER], 1)
    return np.column_stack(
        [
            np.log1p(length),
            np.log1p(words),
            per_doc(spans) / w / 10,
            np.sqrt(np.maximum(per_doc(spans * spans) / w - (per_doc(spans) / w) ** 2, 0)) / 10,
            counts[_UPPER] / letters,
            counts[_DIGIT] / chars,
            counts[_STOP] / chars,
            np.sqrt(counts[_SYMBOL] / chars),
            counts[_BLANK] / chars,
            counts[_OTHER] / chars,
            np.sqrt(shouts / w),
            np.sqrt(bars / w),
            newlines / w,
            kinds / w,
            np.sqrt(top / w),
            np.sqrt(per_doc(again) / w),
            line_kinds / li,
            np.log1p(words / li),
            per_doc(spans <= 3) / w,
            per_doc(spans >= 12) / w,
            per_doc(last == _SYMBOL) / w,
            per_doc(last == _STOP) / w,
            per_doc(first == _UPPER) / w,
        ]
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            x = statistics(texts)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch({"doc_id": rows.column("doc_id"), "x": flat})

    picked = texts_of(docs)
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


class Cosines:
    """Standardises statistics and maps them to random cosines and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.weights = rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), features))
        self.phase = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.weights + self.phase), np.ones(len(x))])


def _summed_equations(labelled: DataFrame, cosines: Cosines, folds: int, width: int) -> dict[int, np.ndarray]:
    """Per fold the matrix [Z'Z | Z'y], summed in partitions and then in slices."""
    size = len(cosines.phase) + 1
    cuts = [int(c) for c in np.linspace(0, size, SLICES + 1)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for rows in batches:
            fold_, y = rows.column("fold").to_numpy(), rows.column("y").to_numpy().astype(float)
            x = _matrix(rows.column("x"), width)
            for i in range(0, len(y), 4096):
                z, part = cosines(x[i : i + 4096]), fold_[i : i + 4096]
                right = np.column_stack([z, y[i : i + 4096]])
                for f in np.unique(part):
                    sums.setdefault(int(f), np.zeros((size, size + 1)))
                    sums[int(f)] += z[part == f].T @ right[part == f]
        yield _packed((f, s, m[cuts[s] : cuts[s + 1]]) for f, m in sums.items() for s in range(SLICES))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for rows in batches:
            for f, s, part in zip(rows.column("fold").to_pylist(), rows.column("slice").to_pylist(), rows.column("part").to_pylist()):
                values = np.frombuffer(part)
                sums[f, s] = sums[f, s] + values if (f, s) in sums else values
        yield _packed((f, s, m) for (f, s), m in sums.items())

    def _packed(rows) -> pa.RecordBatch:
        rows = list(rows)
        return pa.record_batch(
            {
                "fold": pa.array([r[0] for r in rows], pa.int64()),
                "slice": pa.array([r[1] for r in rows], pa.int64()),
                "part": pa.array([np.ascontiguousarray(r[2]).tobytes() for r in rows], pa.binary()),
            }
        )

    schema = "fold long, slice long, part binary"
    parts = labelled.mapInArrow(partial, schema).repartition(folds * SLICES, "fold", "slice").mapInArrow(added, schema)
    whole = {f: np.zeros((size, size + 1)) for f in range(folds)}
    for row in parts.collect():  # folds x slices rows of fixed size
        s = row["slice"]
        whole[row["fold"]][cuts[s] : cuts[s + 1]] = np.frombuffer(row["part"]).reshape(-1, size + 1)
    return whole


def _solved(equations: np.ndarray) -> np.ndarray:
    size = len(equations)
    rows = max(equations[-1, -2], 1.0)  # the constant's square counts rows
    return np.linalg.solve(equations[:, :size] + RIDGE * rows * np.eye(size) / 10, equations[:, size])


class Model:
    def __init__(self, cosines: Cosines, weights: np.ndarray, knots: np.ndarray, levels: np.ndarray) -> None:
        self.cosines, self.weights, self.knots, self.levels = cosines, weights, knots, levels

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        raw = np.concatenate([self.cosines(x[i : i + 4096]) @ self.weights for i in range(0, len(x), 4096)] or [np.zeros(0)])
        return np.interp(raw, self.knots, self.levels)


def fit(measured: DataFrame, labels: DataFrame, target: str = "quality", folds: int = 5, held_out: int = 0) -> Model:
    """Learn from the rows of ``measured`` with a label, but for those of the held-out fold."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(target).cast("int").alias("y")).filter("y IS NOT NULL")
    known = known.groupBy("__id").agg(F.max("y").alias("y"))
    labelled = measured.join(known, measured["doc_id"] == known["__id"]).select("x", "y", fold(F.col("doc_id"), folds).alias("fold"))
    labelled = written(labelled.filter(F.col("fold") != held_out), "quality-labelled")
    width = len(statistics([b""])[0])
    moments = labelled.agg(
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(width)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(width)]
    ).first()
    mean = np.array([moments[i] or 0.0 for i in range(width)])
    cosines = Cosines(mean, np.array([moments[width + i] or 0.0 for i in range(width)]))
    if moments[0] is None:
        return Model(cosines, np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    sums = _summed_equations(labelled, cosines, folds, width)
    total = sum(sums.values())
    others = {f: _solved(total - s) for f, s in sums.items() if s.any()}

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x, fold_ = _matrix(rows.column("x"), width), rows.column("fold").to_numpy()
            raw = np.zeros(len(x))
            for f, weights in others.items():
                raw[fold_ == f] = cosines(x[fold_ == f]) @ weights
            yield pa.record_batch({"y": rows.column("y").cast(pa.int64()), "raw": pa.array(raw)})

    seen = labelled.mapInArrow(unseen, "y long, raw double")
    step = F.least(F.greatest(F.floor((F.col("raw") + 0.5) * (BINS / 2)), F.lit(-1)), F.lit(BINS))
    bins = seen.groupBy(step.alias("bin")).agg(F.count("y").alias("n"), F.sum("y").alias("ones"), F.avg("raw").alias("raw")).orderBy("bin").collect()
    n = np.array([b["n"] for b in bins], float)
    # One row of each label, spread over the bins, keeps levels off 0 and 1.
    level = (np.array([b["ones"] for b in bins]) + 1 / len(bins)) / (n + 2 / len(bins))
    return Model(cosines, _solved(total), *isotonic(np.array([b["raw"] for b in bins]), level, n))


def quality(docs: DataFrame, labels: DataFrame, target: str = "quality", folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    measured = written(document_statistics(docs), "quality-statistics")
    model = fit(measured, labels, target, folds, held_out)
    width = len(statistics([b""])[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield pa.record_batch({"doc_id": rows.column("doc_id"), "score": pa.array(model(_matrix(rows.column("x"), width)))})

    scored = measured.mapInArrow(run, f"doc_id {measured.schema['doc_id'].dataType.simpleString()}, score double")
    out = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, target: str = "quality", least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns; null texts stay null."""
    measured = written(document_statistics(docs), "quality-statistics")
    model = fit(measured, labels, target)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            yield rows.filter(pa.array(model(statistics(texts)) >= least))

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.mapInArrow(run, fields)
