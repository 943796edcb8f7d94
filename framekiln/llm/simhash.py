"""Near duplicates by SimHash fingerprints in a hierarchical index in Gray order.

Fingerprints that differ in at most ``radius`` of 64 bits are linked. The upper nodes of
the index are masked bit patterns: the 64 bits are cut into ``radius + 1`` blocks, and two
linked fingerprints agree in one block at least, so a fingerprint hangs below one node for
each block. A node with more than ``GROUP_ROWS`` fingerprints is cut again, by blocks of
its free bits, until it is small enough; every cut keeps all links, and at the last level
few enough bits are free to bound a node by itself. Below a node the fingerprints lie in
Gray order, where neighbours share long bit patterns. Runs of ``FAN`` are factored into
inner nodes (the bits that all members share, and which bits those are), level by level.
A search goes down pairs of inner nodes, adding up the differences of shared bits, and
drops a pair of whole groups once they exceed the radius; a pair that can't exceed it is
linked whole, without looking at its members.

Only distinct fingerprints are indexed, so copies cost nothing; groups return as a
spanning set of links, never as all pairs.

Cases: null and empty texts and texts of white space have fingerprint zero and are linked
with each other; a null ``doc_id`` never becomes a group's id unless it has no other;
repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framekiln.llm.common import KeyFilter, Tokens, chunks, components, mixed, texts_of
from framekiln.session import written

GROUP_ROWS = 4096
FAN = 16
SMALL = 24


def fingerprint(text: bytes, words: int) -> int:
    """Majority bits of the XXH64 (seed 42) of all shingles, repeats included."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum([len(t) + 1 for t in tokens])
        begins = (ends - [len(t) + 1 for t in tokens])[: len(tokens) - words + 1].tolist()
        hashes = [digest(joined[a:b], 42) for a, b in zip(begins, (ends[words - 1 :] - 1).tolist())]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(values), 65536):
        ones += np.unpackbits(values[i : i + 65536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            values = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch({"doc_id": rows.column("doc_id"), "fp": pa.array(values)})

    picked = texts_of(docs)
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, fp long")


def _cut(mask: int, parts: int) -> list[int]:
    """The free bits of a mask, dealt into ``parts`` blocks; each block is added to the mask."""
    free = [i for i in range(63, -1, -1) if not mask >> i & 1]
    blocks = [b for b in np.array_split(free, min(parts, len(free))) if len(b)]
    return [mask | sum(1 << int(i) for i in b) for b in blocks]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _nodes(fps: DataFrame, radius: int, group_rows: int) -> DataFrame:
    """(mask, pattern, fp): the index's upper nodes with the fingerprints below each."""
    masks, rows, done = [0], fps.select(F.lit(0).cast("long").alias("mask"), "fp"), []
    while True:
        children = {_signed(m): [_signed(c) for c in _cut(m, radius + 1)] for m in masks}
        masks = sorted({c & (1 << 64) - 1 for cs in children.values() for c in cs})
        deal = F.create_map(*[x for m, cs in children.items() for x in (F.lit(m), F.array(*map(F.lit, cs)))])
        rows = rows.select(F.explode(deal[F.col("mask")]).alias("mask"), "fp")
        rows = rows.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask"))).select("mask", "pattern", "fp")
        sizes = rows.groupBy("mask", "pattern").count()
        large = written(sizes.filter(F.col("count") > group_rows).select("mask", "pattern"), "simhash-large")
        if large.isEmpty() or min(64 - m.bit_count() for m in masks) <= 12:
            return rows if not done else _all([*done, rows])
        masks = [r[0] & (1 << 64) - 1 for r in large.select("mask").distinct().collect()]  # a few masks
        done.append(rows.join(large, ["mask", "pattern"], "left_anti"))
        rows = written(rows.join(large, ["mask", "pattern"], "left_semi"), "simhash-nodes")
        rows = rows.select("mask", "fp")


def _all(parts: list[DataFrame]) -> DataFrame:
    union = parts[0]
    for part in parts[1:]:
        union = union.union(part)
    return union


def _gray_rank(fp):
    """Rank of the 64 bits in Gray order, shifted so that signed order is the order of ranks."""
    x = fp
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


class _Forest:
    """Union of links, kept as the smallest index reachable."""

    def __init__(self, size: int) -> None:
        self.root = np.arange(size)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def gray_links(fp: np.ndarray, radius: int, pairs: list | None = None) -> np.ndarray:
    """Root index of each fingerprint of one node; ``fp`` has a row of 64-bit words each, in Gray order.

    If ``pairs`` is given, it gets (a, b, differences) of every single link instead, as arrays.
    """
    forest = _Forest(len(fp))
    levels = [(fp, fp)]  # bits set in all members, bits set in any
    while len(levels[-1][0]) > 1:
        both, any_ = levels[-1]
        cuts = np.arange(0, len(both), FAN)
        levels.append((np.bitwise_and.reduceat(both, cuts), np.bitwise_or.reduceat(any_, cuts)))
    a = b = np.zeros(1, np.int64)
    step = (1 << 15) // fp.shape[1]
    for depth in range(len(levels) - 1, -1, -1):
        both, any_ = levels[depth]
        free = both ^ any_
        span = FAN**depth
        next_a, next_b = [], []
        for i in range(0, len(a), step):
            x, y = a[i : i + step], b[i : i + step]
            open_ = free[x] | free[y]
            least = _bits((both[x] ^ both[y]) & ~open_)
            keep = least <= radius
            x, y, most, least = x[keep], y[keep], (least + _bits(open_))[keep], least[keep]
            if pairs is not None:
                whole = np.zeros(len(x), bool)
                if not depth:
                    own = x < y
                    pairs.append((x[own], y[own], least[own]))
            else:
                whole = most <= radius
            if whole.any():
                wx, wy = x[whole], y[whole]
                forest.add(wx * span, wy * span)
                for w in (wx, wy):  # all members of both nodes are linked with the first
                    w = np.unique(w)
                    member = (w[:, None] * span + np.arange(span)).ravel()
                    head = np.repeat(w * span, span)
                    inside = member < len(fp)
                    forest.add(member[inside], head[inside])
                x, y = x[~whole], y[~whole]
            if depth and len(x):
                width = len(levels[depth - 1][0])
                cx = (x[:, None, None] * FAN + np.arange(FAN)[:, None]) + np.zeros(FAN, np.int64)
                cy = (y[:, None, None] * FAN + np.arange(FAN)[None, :]) + np.zeros((FAN, 1), np.int64)
                cx, cy = cx.ravel(), cy.ravel()
                own = (cx <= cy) & (cy < width)
                next_a.append(cx[own])
                next_b.append(cy[own])
        if not depth or not next_a:
            break
        a, b = np.concatenate(next_a), np.concatenate(next_b)
    return forest.root


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str], most: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Whole nodes of a stream sorted by (mask, pattern): columns, and begin and end of each run of a node.

    Nodes may cross batches; a node of more than ``most`` rows comes in runs that overlap by half.
    """
    held: list[np.ndarray] = []

    def cut_up(rows: list[np.ndarray]):
        edge = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
        begin, end = [], []
        for a, b in zip(np.append(0, edge).tolist(), np.append(edge, len(rows[0])).tolist()):
            for first in range(a, max(a + 1, b - most // 2), most // 2):
                begin.append(first)
                end.append(min(first + most, b))
        return rows[2:], np.array(begin), np.array(end)

    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "pattern", *columns)]
        rows = [np.concatenate([h, n]) for h, n in zip(held, new)] if held else new
        if not len(rows[0]):
            continue
        cut = int(np.argmax((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])))
        if cut:
            yield cut_up([r[:cut] for r in rows])
        held = [r[cut:] for r in rows]
        if len(held[0]) > 4 * most:  # the begin of a long node; half a run stays for the overlap
            yield cut_up(held)
            held = [r[-(most // 2) :] for r in held]
    if held:
        yield cut_up(held)


def _close(bits: np.ndarray, begin: np.ndarray, end: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, differences) of all links in runs of at most ``SMALL`` rows, many runs at a time."""
    size = end - begin
    small = size <= SMALL
    row = np.concatenate([np.arange(a, b) for a, b in zip(begin[small], end[small])] or [np.zeros(0, np.int64)])
    run = np.repeat(np.flatnonzero(small), size[small])
    for step in range(1, SMALL):
        same = np.flatnonzero(run[step:] == run[:-step])
        if not len(same):
            return
        differing = _bits(bits[row[same + step]] ^ bits[row[same]])
        near = differing <= radius
        yield row[same[near]], row[same[near] + step], differing[near]


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of all nodes of a stream of (mask, pattern, fp)."""
    for (fp,), begin, end in _runs(batches, ["fp"], 1 << 20):
        bits = fp.view(np.uint64)[:, None]
        out = [np.zeros((2, 0), np.int64)]
        out += [np.stack([fp[a], fp[b]]) for a, b, _ in _close(bits, begin, end, radius)]
        for i in np.flatnonzero(end - begin > SMALL):
            own = fp[begin[i] : end[i]]
            root = gray_links(bits[begin[i] : end[i]], radius)
            moved = np.flatnonzero(root != np.arange(len(own)))
            out.append(np.stack([own[root[moved]], own[moved]]))
        a, b = np.concatenate(out, axis=1)
        yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})


def _forest_edges(a: np.ndarray, b: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Places of pairs that connect all groups which pairs connect, nearest first; pairs come in rising distance."""
    forest, taken, place = _Forest(int(group.max()) + 1 if len(group) else 0), [], np.arange(len(a))
    a, b = group[a], group[b]
    while True:
        ra, rb = forest.root[a], forest.root[b]
        apart = ra != rb
        if not apart.any():
            return np.sort(np.concatenate(taken)) if taken else place[:0]
        a, b, place, ra, rb = a[apart], b[apart], place[apart], ra[apart], rb[apart]
        first = np.full(len(forest.root), len(a))
        np.minimum.at(first, ra, np.arange(len(a)))
        np.minimum.at(first, rb, np.arange(len(a)))
        chosen = np.unique(first[first < len(a)])  # each group's nearest other one
        taken.append(place[chosen])
        forest.add(ra[chosen], rb[chosen])


def _thinned(ids: np.ndarray, root: np.ndarray, pairs: list[tuple], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b) to verify among those of one run, and the roots that have more."""
    a, b, d = (np.concatenate(x) for x in zip(*pairs))
    apart = root[a] != root[b]
    a, b, d = a[apart], b[apart], d[apart]
    if not len(a):
        return ids[a], ids[b], root[a]
    order = np.lexsort((mixed((ids[a] ^ ids[b]).view(np.uint64)), d))
    a, b = a[order], b[order]
    low = int(min(a.min(), b.min()))
    _, group = np.unique(root[low : int(max(a.max(), b.max())) + 1], return_inverse=True)
    keep = np.zeros(len(a), bool)
    keep[_forest_edges(a - low, b - low, group)] = True
    if most:
        for end in (a, b):  # the nearest of each entry, in order of distance
            by_end = np.argsort(end, kind="stable")
            sorted_ = end[by_end]
            rank = np.arange(len(end)) - np.searchsorted(sorted_, sorted_)
            keep[by_end[rank < most]] = True
    left = np.unique(np.concatenate([root[a[~keep]], root[b[~keep]]]))
    return ids[a[keep]], ids[b[keep]], left


def _nearest(batches: Iterator[pa.RecordBatch], radius: int, parts: list[str], run: int, most: int) -> Iterator[pa.RecordBatch]:
    """(a, b): of each run of a node, pairs that connect its groups, nearest first, and each entry's ``most`` nearest in other groups.

    A row (root, null) tells that a group has more. Each run is thinned by itself, so no more pairs than one run's are ever held.
    """
    for (ids, root, *words), begin, end in _runs(batches, ["id", "root", *parts], run):
        bits = np.column_stack([w.view(np.uint64) for w in words])
        small = list(_close(bits, begin, end, radius))
        found = [_thinned(ids, root, small, most)] if small else []
        for i in np.flatnonzero(end - begin > SMALL):
            pairs: list = []
            own = slice(begin[i], end[i])
            if (root[own] != root[begin[i]]).any():
                gray_links(bits[own], radius, pairs)
            if pairs:
                found.append(_thinned(ids[own], root[own], pairs, most))
        if found:
            a, b, left = (np.concatenate(x) for x in zip(*found))
            left = np.unique(left)
            yield pa.record_batch({"a": pa.array(np.append(a, left)), "b": pa.array([*b.tolist(), *[None] * len(left)], pa.int64())})


def _node_edges(root: np.ndarray, bits: np.ndarray, radius: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) within ``radius`` that connect all groups of a node which such pairs connect; every two runs of it are searched."""
    group = np.unique(root, return_inverse=True)[1]
    forest, edges = _Forest(int(group.max()) + 1), [np.zeros((2, 0), np.int64)]
    begins = np.arange(0, len(root), run)
    for apart in range(len(begins)):
        for first, second in zip(begins[: len(begins) - apart], begins[apart:]):
            rows = np.unique(np.concatenate([np.arange(x, min(x + run, len(root))) for x in (first, second)]))
            own = forest.root[group[rows]]
            if (own == own[0]).all():
                continue
            pairs: list = []
            gray_links(bits[rows], radius, pairs)
            if not pairs:
                continue
            a, b, d = (np.concatenate(x) for x in zip(*pairs))
            open_ = own[a] != own[b]
            a, b, d = a[open_], b[open_], d[open_]
            order = np.argsort(d, kind="stable")
            a, b = a[order], b[order]
            taken = _forest_edges(a, b, own)
            a, b = rows[a[taken]], rows[b[taken]]
            edges.append(np.stack([a, b]))
            forest.add(group[a], group[b])
        if not forest.root.any():
            break  # all are one group
    return tuple(np.concatenate(edges, axis=1))


def _connected(batches: Iterator[pa.RecordBatch], radius: int, parts: list[str], run: int) -> Iterator[pa.RecordBatch]:
    """(a, b): for each whole node, pairs that connect its groups (``root``); no two entries of a node go uncompared unless their groups are connected."""
    for (ids, root, *words), begin, end in _runs(batches, ["id", "root", *parts], 1 << 62):
        bits = np.column_stack([w.view(np.uint64) for w in words])
        near = list(_close(bits, begin, end, radius))
        found = [_thinned(ids, root, near, 0)[:2]] if near else []
        for i in np.flatnonzero(end - begin > SMALL):
            own = slice(begin[i], end[i])
            if (root[own] != root[begin[i]]).any():
                a, b = _node_edges(root[own], bits[own], radius, run)
                found.append((ids[own][a], ids[own][b]))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            yield pa.record_batch({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of codes that every set on the left shares with every one on the right."""
    code, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cut = sum(map(len, left))
    both = (np.bincount(place[:cut], minlength=len(code)) > 0) & (np.bincount(place[cut:], minlength=len(code)) > 0)
    column = np.where(both, np.cumsum(both) - 1, -1)[place]
    out = np.zeros((len(left), len(right)), np.float32)
    sides = [(np.repeat(np.arange(len(x)), [len(s) for s in x]), c, len(x)) for x, c in ((left, column[:cut]), (right, column[cut:]))]
    for first in range(0, int(both.sum()), 4096):
        width = min(4096, int(both.sum()) - first)
        parts = []
        for row, own, size in sides:
            held = (own >= first) & (own < first + width)
            part = np.zeros((size, width), np.float32)
            part[row[held], own[held] - first] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return np.rint(out).astype(np.int64)


def _verify(forest: _Forest, sets: list[np.ndarray], similarity: float, a: np.ndarray, b: np.ndarray, taken: list) -> None:
    """Adds links of pairs that reach the similarity; pairs come in rising distance, and those of one group are left out."""
    size = np.array([len(x) for x in sets])

    def add(a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> None:
        near = shared >= similarity * (size[a] + size[b] - shared) - 1e-9
        a, b = a[near], b[near]
        if len(a):
            spanning = _forest_edges(a, b, forest.root)
            taken.append(np.stack([a[spanning], b[spanning]]))
            forest.add(a, b)

    for _ in range(2):  # most links are found by the nearest pairs
        low = int(min(a.min(), b.min()))
        chosen = _forest_edges(a - low, b - low, np.unique(forest.root[low : int(max(a.max(), b.max())) + 1], return_inverse=True)[1])
        add(a[chosen], b[chosen], np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a[chosen], b[chosen])], np.int64))
        left = np.ones(len(a), bool)
        left[chosen] = False
        left &= forest.root[a] != forest.root[b]
        a, b = a[left], b[left]
        if not len(a):
            return
    if len(a) < 256:
        add(a, b, np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], np.int64))
        return
    left, x = np.unique(a, return_inverse=True)
    right, y = np.unique(b, return_inverse=True)
    for first in range(0, len(left), TILE):
        for second in range(0, len(right), TILE):
            own = np.flatnonzero((x >= first) & (x < first + TILE) & (y >= second) & (y < second + TILE) & (forest.root[a] != forest.root[b]))
            if len(own):
                shared = _shared([sets[i] for i in left[first : first + TILE]], [sets[i] for i in right[second : second + TILE]])
                add(a[own], b[own], shared[x[own] - first, y[own] - second])


def _cell_links(batches: Iterator[pa.RecordBatch], radius: int, similarity: float, parts: list[str]) -> Iterator[pa.RecordBatch]:
    """(a, b): links that connect all entries of each cell with similar sets, among pairs within ``radius``.

    In a cell of two blocks only pairs of entries of different blocks are compared (``block`` is -1 where there is one).
    """
    for (ids, block, codes, *words), begin, end in _runs(batches, ["id", "block", "codes", *parts], 1 << 62):
        bits = np.column_stack([w.view(np.uint64) for w in words])
        sets = [np.frombuffer(x, np.uint64) for x in codes]
        forest, taken = _Forest(len(ids)), [np.zeros((2, 0), np.int64)]

        def compared(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
            open_ = ((block[a] != block[b]) | (block[a] < 0)) & (forest.root[a] != forest.root[b])
            a, b, d = a[open_], b[open_], d[open_]
            if len(a):
                order = np.argsort(d, kind="stable")
                _verify(forest, sets, similarity, a[order], b[order], taken)

        near = list(_close(bits, begin, end, radius))
        if near:
            compared(*(np.concatenate(x) for x in zip(*near)))
        for i in np.flatnonzero(end - begin > SMALL):
            tiles = [np.arange(x, min(x + TILE, end[i])) for x in range(begin[i], end[i], TILE)]
            for apart in range(len(tiles)):
                for x, y in zip(tiles[: len(tiles) - apart], tiles[apart:]):
                    own = forest.root[np.concatenate([x, y])]
                    if (own == own[0]).all():
                        continue
                    d = sum(np.bitwise_count(bits[x, k][:, None] ^ bits[y, k][None, :]).astype(np.int64) for k in range(bits.shape[1]))
                    at, to = np.nonzero(d <= radius)
                    near_ = (at < to) | (apart > 0)
                    at, to = at[near_], to[near_]
                    compared(x[at], y[to], d[at, to])
        a, b = np.concatenate(taken, axis=1)
        yield pa.record_batch({"a": pa.array(ids[a]), "b": pa.array(ids[b])})


def linked(fps: DataFrame, radius: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within ``radius`` bits, over any path."""
    nodes = _nodes(fps.select("fp").distinct(), radius, group_rows)
    placed = nodes.repartition("mask", "pattern").withColumn("rank", _gray_rank(F.col("fp")))
    placed = placed.sortWithinPartitions("mask", "pattern", "rank").drop("rank")
    return placed.mapInArrow(lambda batches: _search(batches, radius), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; the id is the smallest ``doc_id`` reachable by links."""
    marked = written(fingerprints(docs, words), "simhash-docs")
    fps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    roots = components(linked(fps, radius, group_rows), "simhash-links")
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(ids, "root").select("fp", "component_id"), "simhash-named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


PARTS = 4
FIRST_MASKS = 2
RUN = 1024
SHORT = 14
TILE = 512
CELL_BYTES = 16 << 20


def _shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``words`` words; a shorter text is one shingle."""
    tokens = Tokens(texts)
    if not len(tokens.hash):
        return tokens.doc, tokens.hash
    at, last = np.arange(len(tokens.hash)), len(tokens.hash) - 1
    code = np.zeros(len(at), np.uint64)
    for i in range(words):
        there = np.minimum(at + i, last)
        inside = (tokens.doc[there] == tokens.doc) & (at + i <= last)
        code = np.where(inside, mixed(code + tokens.hash[there] + np.array([i + 1], np.uint64)), code)
    final = tokens.first[:-1] + np.maximum(np.diff(tokens.first) - words, 0)
    begins = at <= final[tokens.doc]
    return tokens.doc[begins], code[begins]


def wide_fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """(key, same, short, f0 ... f3): 256 majority bits of the hashes of the different word shingles; ``key`` comes with the text.

    ``same`` is a hash of the set of shingles; ``short`` are the shingles of texts with ``SHORT`` of them at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            doc, code = _shingles(texts, words)
            order = np.lexsort((code, doc))
            doc, code = doc[order], code[order]
            fresh = np.append(True, (np.diff(doc) != 0) | (np.diff(code) != 0))[: len(doc)]
            doc, code = doc[fresh], code[fresh]
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            first, shingles = cut[:-1], np.diff(cut)
            filled = shingles > 0
            out = np.zeros((len(texts), PARTS), np.int64)
            for part in range(PARTS):
                own = np.unpackbits(mixed(code + np.array([part], np.uint64) * _PART).view(np.uint8).reshape(-1, 8), axis=1)
                if len(own):
                    ones = np.add.reduceat(own, first[filled], axis=0, dtype=np.int32)
                    packed = np.packbits(2 * ones > shingles[filled][:, None], axis=1)
                    out[filled, part] = packed.copy().view(np.int64).ravel()
            same = np.array([xxhash.xxh64_intdigest(code[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])], np.uint64).view(np.int64)
            brief = [code[a:b].view(np.int64).tolist() if b - a <= SHORT else None for a, b in zip(cut[:-1], cut[1:])]
            own = {"key": rows.column("key"), "same": pa.array(same), "short": pa.array(brief, pa.list_(pa.int64()))}
            yield pa.record_batch({**own, **{f"f{i}": pa.array(out[:, i].copy()) for i in range(PARTS)}})

    fields = ", ".join(f"f{i} long" for i in range(PARTS))
    return docs.select("key", "text").mapInArrow(run, f"key long, same long, short array<long>, {fields}")


_PART = np.uint64(0xD6E8FEB86659FD93)


def expected_distance(similarity: float, bits: int) -> tuple[float, float]:
    """Mean and deviation of differing bits of two texts whose shingle sets have this Jaccard similarity."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return bits * share, float(np.sqrt(bits * share * (1 - share)))


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, codes): the sorted hashes of each text's different shingles, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            doc, code = _shingles(texts, words)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            sets = [np.unique(code[a:b]) for a, b in zip(cut[:-1], cut[1:])]
            yield pa.record_batch(
                {"id": rows.column("id"), "n": pa.array([len(x) for x in sets], pa.int32()), "codes": pa.array([x.tobytes() for x in sets], pa.binary())}
            )

    return docs.mapInArrow(run, "id long, n int, codes binary")


def short_links(entries: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect all entries with ``short`` sets of shingles which are similar, exactly.

    If the union has ``SHORT`` shingles at most and the similarity is 0.8 or more, two sets differ in one or two. So one of them is
    the other without one or two, or both are equal without one each. Sets without one and without two are hashed, and
    entries that share such a hash are linked with the smallest one: work grows with the entries, whatever their groups.
    """
    sets = entries.filter(F.size("short") > 0).select("id", F.size("short").alias("n"), F.array_sort("short").alias("s"))
    places = F.sequence(F.lit(0), F.col("n") - 1)

    def without(i, j=None):
        return F.xxhash64(F.filter("s", lambda _, k: (k != i) & (k != (i if j is None else j))))

    def kept(shared: Column, union: str) -> Column:
        return shared >= similarity * F.expr(union) - 1e-9

    n = F.col("n")
    ones = F.when(kept(n - 1, "n") | kept(n - 1, "n + 1"), F.transform(places, lambda i: without(i)))
    pairs = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: without(i, j))))
    twos = F.when(kept(n - 2, "n"), pairs)
    kinds = [(0, F.array(F.xxhash64("s"))), (1, ones), (2, twos)]
    empty = F.array().cast("array<struct<key:bigint,missing:int>>")

    def marked(hashes: Column, missing: int) -> Column:
        return F.coalesce(F.transform(hashes, lambda h: F.struct(h.alias("key"), F.lit(missing).alias("missing"))), empty)

    keyed = [marked(hashes, missing) for missing, hashes in kinds]
    rows = sets.select("id", "n", F.explode(F.concat(*keyed)).alias("k")).select("id", "n", "k.*")
    rows = written(rows, "similar-short")
    # The set that is there in whole, and the smallest of those that lack one, per hash.
    whole = F.min(F.when(F.col("missing") == 0, F.col("id"))).alias("whole")
    least = F.min(F.when((F.col("missing") == 1) & kept(n - 1, "n + 1"), F.col("id"))).alias("least")
    heads = rows.groupBy("key").agg(whole, least, F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    met = rows.filter("missing > 0").join(heads, "key")
    to_whole = F.when(kept(n - F.col("missing"), "n"), F.col("whole"))
    to_least = F.when((F.col("missing") == 1) & kept(n - 1, "n + 1"), F.col("least"))
    links = met.select(F.col("id").alias("a"), F.explode(F.array(to_whole, to_least)).alias("b"))
    return links.filter("b IS NOT NULL AND a != b").distinct()


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """(doc_id, key, root, component_id) of every row: groups of texts with a shingle similarity of ``similarity`` or more.

    Candidates differ in no more of 256 bits than the similarity lets expect, plus two
    deviations. Upper nodes are random masks instead of blocks, as so many differences leave no
    whole block equal: a mask takes as many bits as single out some dozens of texts, and there are as many
    masks as let two texts at the threshold agree in one of them with probability ``recall``. Whole nodes are searched,
    however long they are: a node gives pairs that connect all its entries which candidate pairs connect. The first ``FIRST_MASKS`` masks are searched
    in overlapping runs before, dealt to tasks by range; that only joins what lies close together, so that long nodes hold few groups afterwards.

    What candidates connect, over any path, is a cluster. Clusters come together with the whole shingle sets of their texts (Jaccard), all
    pairs of a cluster that differ in no more bits than a candidate are verified, nearest first, but for those of texts that are linked already, and only
    links that reach the similarity count. A cluster with more than ``CELL_BYTES`` of sets is cut into blocks, and every two blocks meet in a cell.
    Rows grow with the texts (times the blocks of their cluster); time grows with the square of a cluster of unlike texts. ``root`` is the key of one of the
    group's texts. Texts of few shingles, whose bits tell less, are linked exactly by ``short_links``. Texts without words form one group.
    """
    docs = texts_of(docs).withColumn("key", F.xxhash64("text"))
    rows = written(docs.select("doc_id", "key"), "similar-rows")
    once = written(wide_fingerprints(docs, words), "similar-prints").dropDuplicates(["key"])
    parts = [f"f{i}" for i in range(PARTS)]
    # Equal sets of shingles are one entry, named by one of their keys; equal fingerprints alone are not.
    once = written(once, "similar-texts")
    entries = once.groupBy("same").agg(F.min("key").alias("id"), F.first("short").alias("short"), *[F.first(p).alias(p) for p in parts])
    entries = written(entries, "similar-entries")
    size = entries.count()
    mean, deviation = expected_distance(similarity, 64 * PARTS)
    radius = int(mean + 2 * deviation)
    picked = min(40, max(6, int(np.ceil(np.log2(max(size, 1) / 32 + 1)))))
    agree = (1 - mean / (64 * PARTS)) ** picked
    masks = int(np.ceil(np.log(1 - recall) / np.log(1 - agree)))
    rng = np.random.default_rng(64)
    chosen = []
    for number in range(masks):
        bits = rng.permutation(64 * PARTS)[:picked]
        mask = [_signed(sum(1 << int(b % 64) for b in bits if b // 64 == part)) for part in range(PARTS)]
        code = F.xxhash64(*[F.col(p).bitwiseAND(F.lit(m)) for p, m in zip(parts, mask)])
        word, turn = F.col(parts[number % PARTS]), 7 * number % 64
        turned = F.shiftleft(word, turn).bitwiseOR(F.shiftrightunsigned(word, 64 - turn)) if turn else word
        chosen.append(F.struct(F.lit(number).alias("mask"), code.alias("pattern"), turned.alias("word")))

    def placed(open_: DataFrame, among: list, deal) -> DataFrame:
        """Entries below the nodes of the masks ``among``, in Gray order."""
        nodes = open_.select("id", "root", *parts, F.explode(F.array(*among)).alias("node")).select("node.*", "id", "root", *parts)
        # One rank below all masks, as its expression is long.
        nodes = nodes.withColumn("rank", _gray_rank(F.col("word"))).drop("word")
        return deal(nodes).sortWithinPartitions("mask", "pattern", "rank", "id").drop("rank")

    def clusters(edges: DataFrame) -> DataFrame:
        return components(edges, "similar-links").withColumnRenamed("node", "id")

    def sets_of(named: DataFrame) -> DataFrame:
        maybe = KeyFilter(named).split(docs, "key", True)
        texts = maybe.join(named, maybe["key"] == named["id"], "left_semi").dropDuplicates(["key"]).select(F.col("key").alias("id"), "text")
        return written(_shingle_sets(texts, words), "similar-sets")

    links = written(short_links(entries, similarity), "similar-reached")
    bare = entries.select("id", *parts)
    by_range = placed(bare.withColumn("root", F.col("id")), chosen[:FIRST_MASKS], lambda n: n.repartitionByRange("mask", "pattern", "rank", "id"))
    near = by_range.mapInArrow(lambda batches: _nearest(batches, radius, parts, RUN, 0), "a long, b long").filter("b IS NOT NULL")
    near = written(near, "similar-near")
    open_ = bare.join(clusters(near.union(links)), "id", "left").withColumn("root", F.coalesce("root", "id"))
    whole = placed(written(open_, "similar-open"), chosen, lambda n: n.repartition("mask", "pattern"))
    more = written(whole.mapInArrow(lambda batches: _connected(batches, radius, parts, RUN), "a long, b long"), "similar-near")
    members = written(clusters(near.union(more).union(links)), "similar-members")
    sets = sets_of(members.select("id"))

    # Equal sets of bytes per cell; an entry is in one cell with each block of its cluster.
    sized = members.join(sets.select("id", F.length("codes").alias("bytes")), "id")
    blocks = sized.groupBy("root").agg(F.ceil(F.sum("bytes") / F.lit(CELL_BYTES)).cast("int").alias("blocks"))
    blocks = written(blocks.withColumn("blocks", F.greatest("blocks", F.lit(1))), "similar-blocks")
    own = F.pmod(F.xxhash64("id", "root"), F.col("blocks")).cast("int")
    cells = members.join(blocks, "root").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("mask")
    cells = cells.select(place, F.col("root").alias("pattern"), "id", F.when(F.col("block") == F.col("other"), -1).otherwise(F.col("block")).alias("block"))
    cells = cells.join(bare, "id").join(sets.select("id", "codes"), "id").withColumn("rank", _gray_rank(F.col(parts[0])))
    cells = cells.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", "rank", "id").drop("rank")
    reached = cells.mapInArrow(lambda batches: _cell_links(batches, radius, similarity, parts), "a long, b long")
    roots = components(links.union(written(reached, "similar-reached")), "similar-links")
    grouped = once.select("key", "same").join(entries.select("same", "id"), "same").select("key", "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
    grouped = written(grouped.select("key", F.coalesce("root", "id").alias("root")), "similar-roots")
    least = rows.join(grouped, "key").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = written(grouped.join(least, "root").select("key", "root", "component_id"), "similar-ids")
    return rows.join(ids, "key").select("doc_id", "key", "root", "component_id")


def without_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of ``similar_groups``, the one with the smallest ``doc_id``.

    Of rows of a group that share this id one is kept; rows without ``doc_id`` go if their group has a row with one.
    """
    columns = docs.columns
    groups = similar_groups(docs, words, similarity)
    lost = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "key").distinct()
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    repeated = first.groupBy("root").count().filter("count > 1").select("root")
    repeated = written(first.join(repeated, "root", "left_semi").select("key", "root").distinct(), "similar-repeated")
    repeated = repeated.withColumnsRenamed({"key": "__same", "root": "__root"})
    lost = written(lost, "similar-lost").withColumnsRenamed({"doc_id": "__id", "key": "__lost"})
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    # Most texts are neither lost nor repeated for sure, and are not shuffled.
    special = KeyFilter(lost.select(F.col("__lost").alias("key")).union(repeated.select("__same")).distinct())
    certain, maybe = special.split(keyed, "__key", False), special.split(keyed, "__key", True)
    kept = maybe.join(lost, maybe["doc_id"].eqNullSafe(lost["__id"]) & (maybe["__key"] == lost["__lost"]), "left_anti")
    single = kept.join(repeated, kept["__key"] == repeated["__same"], "left_anti")
    several = kept.join(repeated, kept["__key"] == repeated["__same"]).dropDuplicates(["__root"])
    return certain.union(single).select(*columns).union(several.select(*columns))
