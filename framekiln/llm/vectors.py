"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors of one label are compared. Copies are one node with a weight. In a block of nodes,
many random projections are sorted; around each node's value a window is opened in each, and the pairs
inside are counted. A pair whose count over all projections reaches a least count is verified by its
cosine in double precision. Window and least count follow from the threshold: a pair just at it reaches
the count with probability ``RECALL`` (binomial), as its difference along a random direction is normal.

A label with more than ``CELL`` nodes is cut first, by the signs of some further projections,
in as many repetitions as let a pair at the threshold meet in one with probability ``RECALL``;
the number of cuts grows with the logarithm of the label's size, so work grows little more than in proportion. Cells
that stay large, because their vectors are alike, are dealt to blocks, and each pair of blocks is one task,
so a task never holds more than two blocks. Tasks return links summed by node and a spanning set of links, never all
pairs; a pair that meets in several repetitions counts in the first.

Cases: vectors that are null, zero or hold null or non-finite numbers, and null labels, link with
nothing; vectors of different length are not compared; repeated rows count as copies; a null
``vec_id`` is never a component's id unless it has no other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framekiln.llm.common import components
from framekiln.session import written

PROJECTIONS = 24
RECALL = 0.995
CELL = 8192
BLOCK = 2048
SEED = 11


def least_collisions(projections: int = PROJECTIONS, recall: float = RECALL) -> int:
    """Largest count that a pair at the threshold reaches with probability ``recall``, for windows of one deviation."""
    p = math.erf(1 / math.sqrt(2))
    below = 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > 1 - recall:
            return count
    return projections


def repetitions(cuts: int, threshold: float, recall: float = RECALL) -> int:
    """Repetitions of ``cuts`` sign cuts so that a pair at the threshold shares a cell once."""
    if not cuts:
        return 1
    meet = (1 - math.acos(threshold) / math.pi) ** cuts
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _unit(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _directions(width: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng((SEED, seed, width)).normal(size=(width, count))


def colliding(left: np.ndarray, right: np.ndarray, window: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of left, row of right) whose projections collide at least ``least`` times."""
    counts = np.zeros(len(left) * len(right), np.int32)
    for k in range(left.shape[1]):
        order = np.argsort(right[:, k], kind="stable")
        line = right[order, k]
        begin = np.searchsorted(line, left[:, k] - window, side="left")
        end = np.searchsorted(line, left[:, k] + window, side="right")
        size = end - begin
        row = np.repeat(np.arange(len(left)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        counts[row * len(right) + order[place]] += 1  # a pair occurs once per projection
    hit = np.flatnonzero(counts >= least)
    return hit // len(right), hit % len(right)


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    root = np.arange(size)
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    value = F.col("embedding")
    norm = F.aggregate(value, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    usable = F.col("label").isNotNull() & (norm > 0) & (norm < float("inf")) & ~F.exists(value, lambda x: F.isnan(x) | x.isNull())
    rows = vectors.select("vec_id", "embedding", "label").withColumn("ok", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumn("node", F.when(F.col("ok"), F.xxhash64("label", "embedding")))
    nodes = rows.filter("ok").groupBy("node", "label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    nodes = written(nodes.withColumn("width", F.size("embedding")), "vectors-nodes")

    sizes = nodes.groupBy("label", "width").agg(F.count(F.lit(1)).alias("size"))
    cuts = F.ceil(F.greatest(F.lit(0.0), F.log2(F.col("size") / F.lit(float(cell))))).cast("int")
    sized = nodes.join(sizes.select("label", "width", cuts.alias("cuts")), ["label", "width"])
    label = nodes.schema["label"].dataType.simpleString()
    number = nodes.schema["embedding"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            wide, cut = batch.column("width").to_numpy(), batch.column("cuts").to_numpy()
            for width, t in sorted(set(zip(wide.tolist(), cut.tolist()))):
                own = batch.filter(pa.array((wide == width) & (cut == t)))
                times = repetitions(t, threshold)
                if t:
                    signs = _unit(own.column("embedding"), width) @ _directions(width, t * times, 1) > 0
                    codes = signs.reshape(len(signs), times, t) @ (1 << np.arange(t))
                else:
                    codes = np.zeros((own.num_rows, 1), np.int64)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(own.num_rows + 1) * times, pa.int32()), pa.array(codes.ravel()))
                for turn in range(times):
                    yield pa.record_batch(
                        {
                            **{c: own.column(c) for c in ("label", "width", "node", "weight", "embedding")},
                            "turn": pa.array(np.full(own.num_rows, turn), pa.int32()),
                            "cell": pa.array(codes[:, turn]),
                            "codes": listed,
                        }
                    )

    keys = ["label", "width", "turn", "cell"]
    placed = sized.select("label", "width", "node", "weight", "embedding", "cuts").mapInArrow(
        place, f"label {label}, width int, node long, weight long, embedding {number}, turn int, cell long, codes array<long>"
    )
    placed = written(placed, "vectors-cells")
    blocks = placed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("blocks"))
    dealt = placed.join(blocks, keys).withColumn("own", F.pmod(F.xxhash64("node", "turn"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "blocks")

    window, least = math.sqrt(2 * (1 - threshold)), least_collisions()

    def link(key: tuple, part: pa.Table) -> pa.Table:
        width, turn, low, high = (k.as_py() for k in (key[1], key[2], key[4], key[5]))
        part = part.combine_chunks()
        own = part.column("own").to_numpy()
        x = _unit(part.column("embedding").combine_chunks(), width)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        at, to = np.flatnonzero(own == low), np.flatnonzero(own == high)
        lines = x @ _directions(width, PROJECTIONS, 2)
        a, b = colliding(lines[at], lines[to], window, least)
        a, b = at[a], to[b]
        if low == high:
            a, b = a[a < b], b[a < b]
        keep = np.zeros(len(a), bool)
        for i in range(0, len(a), 1 << 16):
            s = slice(i, i + (1 << 16))
            keep[s] = np.einsum("ij,ij->i", x[a[s]], x[b[s]]) >= threshold
        a, b = a[keep], b[keep]
        if turn and len(a):
            codes = _unit(part.column("codes").combine_chunks(), -1 if not len(x) else len(part.column("codes")[0])).astype(np.int64)
            new = ~(codes[a, :turn] == codes[b, :turn]).any(axis=1)
            a, b = a[new], b[new]
        node, weight = part.column("node").to_numpy(), part.column("weight").to_numpy()
        links = np.bincount(a, weight[b], len(x)) + np.bincount(b, weight[a], len(x))
        root = _forest(a, b, len(x))
        linked, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(x)))
        return pa.table(
            {
                "a": pa.array(np.append(node[linked], node[moved])),
                "b": pa.array(np.append(node[linked], node[root[moved]])),
                "links": pa.array(np.append(links[linked], np.zeros(len(moved))).astype(np.int64)),
            }
        )

    found = written(dealt.groupBy(*keys, "low", "high").applyInArrow(link, "a long, b long, links long"), "vectors-links")
    counts = found.filter("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("a != b").select("a", "b"), "vectors-components")
    known = nodes.select("node", "least", "weight").join(counts, "node", "left").join(roots, "node", "left")
    known = known.select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("root", "node").alias("root"))
    known = written(known, "vectors-rooted")
    ids = known.groupBy("root").agg(F.min("least").alias("component"))
    named = written(known.join(ids, "root").select("node", "links", "component"), "vectors-named")
    component = F.when(F.col("node").isNotNull(), F.col("component")).otherwise(F.col("vec_id"))
    return rows.join(named, "node", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
