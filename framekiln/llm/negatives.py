"""Hard negatives by angular triangle filtering.

Vectors are turned into whole numbers; a score is their inner product. Every row stores its norm and its angles to a
few reference directions. For an anchor at angle ``t`` and rows at angles ``low`` to ``high`` of a reference, their mutual angle
lies between ``max(low - t, t - high, 0)`` and ``min(t + high, 2 pi - t - low)``; the narrowest interval over the references,
times the norms and widened by more than rounding can shift it, bounds the scores. An anchor asks for a window of scores, and
only rows whose bounds overlap it are scored, in exact integer arithmetic.

Rows lie in blocks of one nearest reference (``ROWS`` at most), inside a task in runs of one label and similar
angle. An anchor first searches one block of its own cell; the last score that this leaves within the
wanted number narrows its window. Then it visits the other blocks whose bounds overlap: one task per block of
rows and group of anchors, so neither side is ever held whole. First this finds the ``positives`` best rows of the anchor's label, then,
for each of them, the ``negatives`` best rows of other labels whose score is ``low`` to ``high`` percent of the positive's.

The references are chosen among ``SAMPLE`` rows (farthest first); they decide the speed, never the result. The bounds of
blocks that tasks receive are at most ``MOST_BLOCKS`` and a few, as blocks grow with the table beyond.

Cases: rows with a null id, a null label, a null vector, null or non-finite entries, or a norm of 2^28 or more (whole
numbers; products could leave 64 bits) take no part; vectors of different width are never compared, and empty ones score 0; an anchor's other rows are those of another
``vec_id``; repeated rows are rows of their own among candidates, while an anchor that repeats counts once; ties go to the smaller
``vec_id``; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framekiln.session import written

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
REFERENCES = 16
SAMPLE = 2048
ROWS = 32768
ANCHORS = 16384
MOST_BLOCKS = 65536
RUN = 256
FLUSH = 1 << 20
# Angles are stored as 32-bit numbers.
SLACK = 2e-6
MOST_NORM = 2.0**28
LEAST_SCORE, MOST_SCORE = -(1 << 62), 1 << 62
_FOUND = "anchor long, place int, vec_id long, score long"
_BLOCK = ["width", "cell", "part"]


def references(sample: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors (rows) far from each other, chosen among the sample's."""
    norm = np.linalg.norm(sample, axis=1)
    unit = sample[norm > 0] / norm[norm > 0, None]
    if not len(unit):
        return np.eye(count, sample.shape[1])
    chosen = [0]
    nearest = unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[[chosen[i % len(chosen)] for i in range(count)]]


def angles_to(x: np.ndarray, norm: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angle of every row to every direction; a right angle for a zero vector, whose bounds are 0 by its norm."""
    cosine = x @ directions.T / np.where(norm > 0, norm, 1)[:, None]
    return np.arccos(np.clip(cosine, -1, 1))


def score_bounds(
    angles: np.ndarray, norm: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) score of each anchor (angles, norm) with each set of rows (angles low to high, norms least to most)."""
    near = np.zeros((len(angles), len(low)))
    far = np.full(near.shape, np.pi)
    for k in range(angles.shape[1]):
        t = angles[:, k, None].astype(float)
        near = np.maximum(near, np.maximum(low[:, k] - t, t - high[:, k]))
        far = np.minimum(far, np.minimum(t + high[:, k], 2 * np.pi - t - low[:, k]))
    top = np.cos(np.clip(near - SLACK, 0, np.pi))
    bottom = np.cos(np.clip(far + SLACK, 0, np.pi))
    upper = norm[:, None] * np.maximum(top * most, top * least)
    lower = norm[:, None] * np.minimum(bottom * most, bottom * least)
    return lower - 0.5 - 1e-9 * np.abs(lower), upper + 0.5 + 1e-9 * np.abs(upper)


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(kind, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def _windows(column: pa.ChunkedArray, width: int, fill: int) -> np.ndarray:
    out = np.full((len(column), width), fill, np.int64)
    for i, values in enumerate(column.to_pylist()):
        out[i, : len(values)] = values
    return out


def _best(found: list[tuple], want: int) -> list[tuple]:
    """The first ``want`` (anchor, place, vec_id, score) of each anchor and place."""
    if not found:
        return []
    anchor, place, vec, score = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((vec, -score, place, anchor))
    anchor, place, vec, score = anchor[order], place[order], vec[order], score[order]
    first = np.append(True, (np.diff(anchor) != 0) | (np.diff(place) != 0))
    begin = np.flatnonzero(first)
    keep = np.arange(len(anchor)) - np.repeat(begin, np.diff(np.append(begin, len(anchor)))) < want
    return [(anchor[keep], place[keep], vec[keep], score[keep])]


def _scored(rows: pa.Table, asked: pa.Table, want: int, same: bool, run: int) -> list[tuple]:
    """Best rows of one block for one group of anchors, as ``_best`` gives them (anchors by number)."""
    names = {v: i for i, v in enumerate(dict.fromkeys(rows["label"].to_pylist() + asked["label"].to_pylist()))}
    label, own = (np.array([names[v] for v in t["label"].to_pylist()]) for t in (rows, asked))
    angle = _matrix(rows["angles"], np.float64)
    nearest = angle.mean(axis=0).argmin()
    order = np.lexsort((angle[:, nearest], label))
    label, angle, x = label[order], angle[order], _matrix(rows["x"], np.int64)[order]
    vec, norm = rows["vec_id"].to_numpy()[order], rows["norm"].to_numpy()[order]
    fresh = np.append(True, np.diff(label) != 0)
    start = np.flatnonzero(fresh)
    offset = np.arange(len(label)) - np.repeat(start, np.diff(np.append(start, len(label))))
    begin = np.flatnonzero(offset % run == 0)
    ends = np.append(begin[1:], len(label))

    lower, upper = score_bounds(
        _matrix(asked["angles"], np.float64),
        asked["norm"].to_numpy(),
        np.minimum.reduceat(angle, begin),
        np.maximum.reduceat(angle, begin),
        np.minimum.reduceat(norm, begin),
        np.maximum.reduceat(norm, begin),
    )
    wide = max(len(v) for v in asked["lows"].to_pylist())
    lows, highs = _windows(asked["lows"], wide, MOST_SCORE), _windows(asked["highs"], wide, LEAST_SCORE)
    y, ids = _matrix(asked["x"], np.int64), asked["vec_id"].to_numpy()
    # Doubles hold these products and sums exactly below 2^53; beyond, whole numbers of 64 bits do.
    if norm.max() * asked["norm"].to_numpy().max() < 2.0**52:
        x, y = x.astype(float), y.astype(float)
    best = np.full((len(ids), wide, want), LEAST_SCORE - 1)
    found, held = [], 0
    for s in np.argsort(-upper.max(axis=0), kind="stable"):
        part = slice(begin[s], ends[s])
        fits = (own == label[begin[s]]) == same
        overlap = fits[:, None] & (upper[:, s, None] >= lows) & (lower[:, s, None] <= highs) & (lows <= highs)
        who = np.flatnonzero(overlap.any(axis=1))
        if not len(who):
            continue
        scores = (y[who] @ x[part].T).astype(np.int64)
        other = vec[part][None, :] != ids[who, None]
        for w in np.flatnonzero(overlap.any(axis=0)):
            inside = other & (scores >= lows[who, w, None]) & (scores <= highs[who, w, None])
            masked = np.where(inside, scores, LEAST_SCORE - 1)
            merged = np.concatenate([best[who, w], masked], axis=1)
            best[who, w] = np.partition(merged, merged.shape[1] - want, axis=1)[:, -want:]
            lows[who, w] = np.maximum(lows[who, w], best[who, w].min(axis=1))
            i, j = np.nonzero(masked >= lows[who, w, None])
            found.append((who[i], np.full(len(i), w), vec[part][j], scores[i, j]))
            held += len(i)
        if held > FLUSH:
            found = _best(found, want)
            held = len(found[0][0])
    return _best(found, want)


def _search(rows: DataFrame, asked: DataFrame, want: int, same: bool, run: int, label: str) -> DataFrame:
    """(anchor, place, vec_id, score): what each block that an anchor asks has best in each of its windows."""
    asked = written(asked, f"{label}-asked")
    pairs = asked.select(*_BLOCK, F.col("group").alias("team")).distinct()
    near = rows.join(pairs, _BLOCK).select(*_BLOCK, "team", "vec_id", "label", "norm", "angles", "x")

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _scored(left, right, want, same, run) if left.num_rows and right.num_rows else []
        anchor, place, vec, score = found[0] if found else (np.zeros(0, np.int64),) * 4
        return pa.table(
            {
                "anchor": right["anchor"].to_numpy()[anchor] if len(anchor) else pa.array([], pa.int64()),
                "place": pa.array(place, pa.int32()),
                "vec_id": pa.array(vec, pa.int64()),
                "score": pa.array(score, pa.int64()),
            }
        )

    return written(near.groupBy(*_BLOCK, "team").cogroup(asked.groupBy(*_BLOCK, "group")).applyInArrow(task, _FOUND), f"{label}-found")


class _Index:
    """Placed rows, and the bounds of their blocks."""

    def __init__(self, rows: DataFrame, per_block: int) -> None:
        sample = rows.select("x").orderBy(F.xxhash64("x")).limit(SAMPLE).toArrow()["x"].to_pylist()
        chosen = {w: references(np.array([v for v in sample if len(v) == w], float)) for w in {len(v) for v in sample} if w}

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                widths = batch.column("x").value_lengths().to_numpy()
                for width in np.unique(widths).tolist():
                    part = batch.filter(pa.array(widths == width))
                    x = _matrix(part.column("x"), np.float64).reshape(part.num_rows, width)
                    directions = chosen.get(width)
                    if directions is None:
                        directions = np.eye(REFERENCES, max(width, 1))[:, :width]
                    angles = angles_to(x, part.column("norm").to_numpy(), directions)
                    yield pa.record_batch(
                        {
                            **{n: part.column(n) for n in part.schema.names},
                            "width": pa.array(np.full(len(x), width), pa.int32()),
                            "cell": pa.array(angles.argmin(axis=1), pa.int32()),
                            "angles": pa.FixedSizeListArray.from_arrays(pa.array(angles.ravel(), pa.float32()), REFERENCES).cast(pa.list_(pa.float32())),
                        }
                    )

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        placed = rows.mapInArrow(place, f"{schema}, width int, cell int, angles array<float>")
        placed = written(placed.withColumn("deal", F.monotonically_increasing_id()), "negatives-placed")
        self.count = placed.count()
        size = max(per_block, -(-self.count // MOST_BLOCKS))
        cells = placed.groupBy("width", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(size))).cast("int").alias("parts"))
        self.cells = written(cells, "negatives-cells")
        self.rows = self.dealt(placed, "deal")
        ends = [f(F.col("angles")[k]).alias(f"{n}{k}") for n, f in (("low", F.min), ("high", F.max)) for k in range(REFERENCES)]
        bounds = self.rows.groupBy(*_BLOCK).agg(F.min("norm").alias("least"), F.max("norm").alias("most"), *ends)
        held = bounds.orderBy(*_BLOCK).toArrow()  # one row per block
        self.blocks = {n: held[n].to_numpy() for n in (*_BLOCK, "least", "most")}
        self.low, self.high = (np.column_stack([held[f"{n}{k}"].to_numpy() for k in range(REFERENCES)]).astype(float) for n in ("low", "high"))

    def dealt(self, rows: DataFrame, number: str) -> DataFrame:
        """``rows`` with the block ``part`` of their cell. There is one row per width and reference, so that side is small."""
        few = self.cells.count() <= MOST_BLOCKS
        return rows.join(F.broadcast(self.cells) if few else self.cells, ["width", "cell"]).withColumn("part", F.pmod(F.col(number), "parts").cast("int")).drop("parts")

    def overlapping(self, asked: DataFrame) -> DataFrame:
        """One row per anchor and block whose score bounds overlap a window of the anchor, but for its first block."""
        blocks, lows, highs = self.blocks, self.low, self.high
        names = asked.columns

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, (1 << 21) // max(1, len(blocks["part"])))
            for whole in batches:
                for begin in range(0, whole.num_rows, step):
                    batch = whole.slice(begin, step)
                    angle = _matrix(batch.column("angles"), np.float64)
                    lower, upper = score_bounds(angle, batch.column("norm").to_numpy(), lows, highs, blocks["least"], blocks["most"])
                    hit = np.zeros(upper.shape, bool)
                    wide = max((len(v) for v in batch.column("lows").to_pylist()), default=0)
                    least, most = _windows(batch.column("lows"), wide, MOST_SCORE), _windows(batch.column("highs"), wide, LEAST_SCORE)
                    for w in range(wide):
                        hit |= (upper >= least[:, w, None]) & (lower <= most[:, w, None]) & (least[:, w] <= most[:, w])[:, None]
                    own = [batch.column(n).to_numpy()[:, None] for n in _BLOCK]
                    hit &= own[0] == blocks["width"]
                    hit &= (own[1] != blocks["cell"]) | (own[2] != blocks["part"])
                    i, j = np.nonzero(hit)
                    for at in range(0, len(i), 4096):
                        a, b = i[at : at + 4096], j[at : at + 4096]
                        taken = batch.take(pa.array(a))
                        columns = {n: pa.array(blocks[n][b], pa.int32()) if n in _BLOCK else taken.column(n) for n in names}
                        yield pa.record_batch(columns)

        return asked.mapInArrow(visit, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema))


def _ranked(found: DataFrame, want: int) -> DataFrame:
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= want)


def _windowed_search(index: _Index, asked: DataFrame, want: int, same: bool, run: int, label: str) -> DataFrame:
    """(anchor, place, vec_id, score, rank) in whole: first in one block per anchor, then in all that can still matter."""
    first = _search(index.rows, asked, want, same, run, f"{label}-first")
    full = _ranked(first, want).groupBy("anchor", "place").agg(F.count_if(F.col("rank") == want).alias("full"), F.min("score").alias("least"))
    least = full.filter("full > 0").groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", "least"))).alias("least"))
    raised = F.transform("lows", lambda low, i: F.greatest(low, F.coalesce(F.col("least")[i], low)))
    narrowed = asked.join(least, "anchor", "left").withColumn("lows", raised).select(*asked.columns)
    rest = _search(index.rows, index.overlapping(written(narrowed, f"{label}-narrowed")), want, same, run, f"{label}-rest")
    return written(_ranked(first.unionByName(rest), want), f"{label}-best")


def mined(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: float = 256.0,
    per_block: int = ROWS,
    per_group: int = ANCHORS,
    run: int = RUN,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has (vec_id, label, embedding); ``is_anchor`` is a condition on them. Entries count as ``floor(scale * entry)``.
    """
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    usable &= ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform("embedding", lambda c: F.floor(F.lit(scale) * c.cast("double")))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    rows = vectors.select("vec_id", "label", "embedding").filter(usable).withColumn("asks", F.coalesce(is_anchor, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long"), "label", "asks", x.alias("x")).withColumn("norm", norm).filter(F.col("norm") < MOST_NORM)
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = _Index(written(rows, "negatives-rows"), per_block)
    if not index.count:
        return vectors.sparkSession.createDataFrame([], result)

    # Anchors of one cell are side by side in groups, and each starts in one block of its cell.
    own = index.rows.filter("asks").drop("asks", "deal", "part").dropDuplicates(["vec_id", "label", "x"])
    own = written(own.withColumn("anchor", F.monotonically_increasing_id()), "negatives-anchors")
    before = Window.partitionBy("width").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy("width", "cell").agg(F.count(F.lit(1)).alias("anchors"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("anchors").over(before), F.lit(0)))
    group = F.floor((F.col("before") + F.pmod(F.xxhash64("anchor"), "anchors")) / F.lit(per_group)).cast("int")
    own = index.dealt(own.join(sizes, ["width", "cell"]).withColumn("group", group).drop("before", "anchors"), "anchor")
    own = written(own, "negatives-grouped")

    wide_open = own.withColumns({"lows": F.array(F.lit(LEAST_SCORE)), "highs": F.array(F.lit(MOST_SCORE))})
    best = _windowed_search(index, wide_open, positives, True, run, "negatives-positives")
    best = best.select("anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    window = F.struct("place", "positive_score")
    asked = best.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(window)), lambda w: w["positive_score"]).alias("scores"))
    # ceil(low * s / 100) and floor(high * s / 100) in whole numbers; for s < 0 no score lies between.
    at_least = F.expr(f"transform(scores, s -> (s * {low} + pmod(-(s * {low}), 100)) div 100)")
    at_most = F.expr(f"transform(scores, s -> (s * {high} - pmod(s * {high}, 100)) div 100)")
    asked = own.join(asked.select("anchor", at_least.alias("lows"), at_most.alias("highs")), "anchor")
    found = _windowed_search(index, asked, negatives, False, run, "negatives-negatives")
    named = found.join(best, ["anchor", "place"]).join(own.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
