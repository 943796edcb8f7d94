"""Whitening by incremental eigendecomposition.

1. Every partition of the distinct vectors keeps a count, a mean and the eigendecomposition of its scatter matrix. A vector
   ``x`` adds ``n / (n + 1) d d'`` with ``d = x - mean``: a rank-one update, whose eigenvalues are the roots of a secular
   equation, one between each two neighbouring old ones. Directions that ``d`` hardly touches, and equal eigenvalues, are
   deflated: their pairs stay as they are, or are rotated into one.
2. Spectra of partitions are combined, eight at a time over a tree of grouped tasks, by successive rank-one updates: one for each
   eigenpair of the other spectrum and one for the difference of the means.
3. Rayleigh-Ritz refinement: the covariance is projected on the basis so found in one pass over all vectors,
   summed over partitions by the same tree, and diagonalised. The basis spans the whole space, so this leaves rounding only,
   and the roots of step 1 need few digits.

Sums are exact: ``n`` and the sum ``S`` are integers, and ``deviation`` is computed in integers. Only one spectrum and one
matrix of the vectors' width squared ever reach the driver. An update costs about width squared times the iterations and one product of width cubed, so the
method suits widths to some hundreds.

Cases: rows whose vector is null, empty or holds null or non-finite entries have no result; repeated rows each get
theirs, but are fitted once; vectors of different width are whitened apart; fewer components come out where
there are fewer dimensions or the others have no variance (so none for a single vector); a ``deviation`` beyond 64 bits is
null; a null ``vec_id`` is kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framekiln.session import written

COMPONENTS = 4
FAN_IN = 8
STEPS = 12
DIGITS = 1e-6
# Shares of the trace below which a direction has no variance, and of the largest eigenvalue below which a pair is deflated.
NO_VARIANCE = 1e-12
DEFLATE = 1e-14

_SPECTRUM = "width int, slot long, n long, sums array<decimal(38,0)>, mean array<double>, spread array<double>, basis array<double>"
_MATRIX = "width int, slot long, n long, total array<double>, products array<double>"
_RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def _secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(d) + rho z z', for rising ``d`` and no zeros in ``z``.

    All roots at once, as offsets from their nearer pole, by two-pole interpolation kept inside a bracket. The vectors follow from a ``z``
    recomputed from the roots, so they are orthogonal however exact these are.
    """
    k = len(d)
    if k == 1:
        return d + rho * z * z, np.ones((1, 1))
    weight = rho * z * z
    right = np.append(d[1:], d[-1] + weight.sum())
    half = (right - d) / 2
    apart = d[:, None] - d[None, :]
    rises = 1 + (weight[:, None] / (apart - half)).sum(axis=0) >= 0
    own = rises.copy()
    own[-1] = True  # the last root has no pole on its right
    pole = np.arange(k) + ~own
    delta = d[:, None] - d[pole][None, :]
    low, high = np.where(own, 0.0, -half), np.where(own, half, 0.0)
    if not rises[-1]:
        low[-1], high[-1] = half[-1], 2 * half[-1] * (1 + 1e-12)
    to_left, to_right = d - d[pole], right - d[pole]
    to_right[-1] = right[-1] - d[-1]
    below = np.tri(k).T  # [pole j, root i]: j <= i
    tau = (low + high) / 2
    for _ in range(STEPS):
        gap = delta - tau
        term = weight[:, None] / gap
        slope = term / gap
        psi = np.einsum("ji,ji->i", slope, below)
        all_slope = slope.sum(axis=0)
        f = 1 + term.sum(axis=0)
        negative = f < 0
        low, high = np.where(negative, tau, low), np.where(negative, high, tau)
        left, far = to_left - tau, to_right - tau
        c = f - left * psi - far * (all_slope - psi)
        a = (left + far) * f - left * far * all_slope
        b = left * far * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        small = np.abs(step) <= DIGITS * np.abs(tau)
        new = tau + step
        tau = np.where(small, tau, np.where((new > low) & (new < high), new, (low + high) / 2))
        if small.all():
            break
    gap = delta - tau
    np.fill_diagonal(apart, -1.0)
    z = np.copysign(np.sqrt(np.abs(np.prod(gap / apart.T * -1, axis=1))), z)
    vectors = z[:, None] / gap
    return d[pole] + tau, vectors / np.sqrt(np.einsum("ji,ji->i", vectors, vectors))


def rank_one(spread: np.ndarray, basis: np.ndarray, d: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``basis diag(spread) basis' + rho d d'``."""
    z = d @ basis
    size = float(z @ z)
    limit = DEFLATE * max(spread[-1], rho * size)
    if not rho * size > limit:
        return spread, basis
    close = np.diff(spread) <= limit
    if close.any():
        basis = basis.copy()
        edges = np.flatnonzero(np.diff(np.concatenate([[False], close, [False]]).astype(np.int8)))
        for begin, end in edges.reshape(-1, 2):  # equal values begin .. end: reflect their part of z on the last
            run = slice(begin, end + 1)
            part = z[run].copy()
            length = np.sqrt(part @ part)
            mirror = part.copy()
            mirror[-1] += np.copysign(length, part[-1])
            square = mirror @ mirror
            if square > 0:
                basis[:, run] -= np.outer(basis[:, run] @ mirror, mirror) * (2 / square)
                z[run] = 0
                z[end] = -np.copysign(length, part[-1])
    live = rho * np.abs(z) * np.sqrt(size) > limit
    if not live.any():
        return spread, basis
    with np.errstate(all="ignore"):
        values, turn = _secular(spread[live], z[live], rho)
    if not (np.isfinite(values).all() and np.isfinite(turn).all()):  # poles closer than rounding can tell
        values, turn = np.linalg.eigh(np.diag(spread[live]) + rho * np.outer(z[live], z[live]))
    if live.all():
        return values, basis @ turn
    spread, turned = spread.copy(), basis.copy()
    spread[live], turned[:, live] = values, basis[:, live] @ turn
    order = np.argsort(spread, kind="stable")
    return spread[order], turned[:, order]


class Spectrum:
    """Count, exact sums, mean and eigendecomposition of the scatter matrix of vectors."""

    def __init__(self, width: int) -> None:
        self.n, self.sums = 0, [0] * width
        self.mean, self.spread, self.basis = np.zeros(width), np.zeros(width), np.eye(width)

    def add(self, x: np.ndarray) -> None:
        """The rows of an integer matrix, one update each."""
        # Halves of 32 bits, as sums of whole numbers may leave 64 bits.
        high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
        self.sums = [s + (int(h) << 32) + int(w) for s, h, w in zip(self.sums, high, low)]
        for row in x.astype(float):
            d = row - self.mean
            if self.n:
                self.spread, self.basis = rank_one(self.spread, self.basis, d, self.n / (self.n + 1))
            self.n += 1
            self.mean = self.mean + d / self.n

    def join(self, other: Spectrum) -> None:
        """Add another spectrum's vectors by one update for each of its pairs, and one for the means."""
        if not other.n:
            return
        for value, vector in zip(other.spread, other.basis.T):
            if value > 0:
                self.spread, self.basis = rank_one(self.spread, self.basis, vector, float(value))
        n, d = self.n + other.n, other.mean - self.mean
        if self.n:
            self.spread, self.basis = rank_one(self.spread, self.basis, d, self.n * other.n / n)
        self.n, self.mean = n, self.mean + d * (other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(width, rows, matrix of x) of each batch and width."""
    for batch in batches:
        widths = batch.column("x").value_lengths().to_numpy()
        for width in np.unique(widths).tolist():
            part = batch.filter(pa.array(widths == width))
            yield width, part, part.column("x").flatten().to_numpy().reshape(-1, width)


def _tree(parts: DataFrame, slots: int, combine: Callable[[tuple, pa.Table], pa.Table], schema: str, label: str) -> pa.Table:
    """One row per width: rows of neighbouring slots are combined, ``FAN_IN`` at a time, until one slot is left."""
    parts = written(parts, label)
    while slots > 1:
        slots = -(-slots // FAN_IN)
        grouped = parts.withColumn("slot", F.floor(F.col("slot") / FAN_IN)).groupBy("width", "slot")
        parts = written(grouped.applyInArrow(combine, schema), label)
    return parts.toArrow()


def _array(rows: list, kind: pa.DataType) -> pa.Array:
    return pa.array([list(r) for r in rows], pa.list_(kind))


def _spectra(fit: DataFrame, slots: int) -> dict[int, Spectrum]:
    from decimal import Decimal

    def table(held: dict[int, Spectrum], slot: int) -> dict:
        own = [(w, s) for w, s in held.items() if s.n]
        return {
            "width": pa.array([w for w, _ in own], pa.int32()),
            "slot": pa.array([slot] * len(own), pa.int64()),
            "n": pa.array([s.n for _, s in own], pa.int64()),
            "sums": _array([map(Decimal, s.sums) for _, s in own], pa.decimal128(38, 0)),
            "mean": _array([s.mean for _, s in own], pa.float64()),
            "spread": _array([s.spread for _, s in own], pa.float64()),
            "basis": _array([s.basis.ravel() for _, s in own], pa.float64()),
        }

    def read(row: dict) -> Spectrum:
        spectrum = Spectrum(row["width"])
        spectrum.n, spectrum.sums = row["n"], [int(s) for s in row["sums"]]
        spectrum.mean, spectrum.spread = np.array(row["mean"]), np.array(row["spread"])
        spectrum.basis = np.array(row["basis"]).reshape(row["width"], -1)
        return spectrum

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, Spectrum] = {}
        for width, _, x in _blocks(batches):
            held.setdefault(width, Spectrum(width)).add(x)
        if held:
            yield pa.record_batch(table(held, TaskContext.get().partitionId()))

    def combine(key: tuple, part: pa.Table) -> pa.Table:
        width, slot = key[0].as_py(), key[1].as_py()
        parts = sorted((read(row) for row in part.to_pylist()), key=lambda s: (-s.n, s.sums))
        for other in parts[1:]:
            parts[0].join(other)
        return pa.table(table({width: parts[0]}, slot))

    found = _tree(fit.select("x").mapInArrow(scan, _SPECTRUM), slots, combine, _SPECTRUM, "whitening-spectra")
    return {row["width"]: read(row) for row in found.to_pylist()}


def _products(fit: DataFrame, slots: int, centres: dict[int, tuple], axes: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Per width the covariance of the centred vectors' coordinates on ``axes``, in one pass over all of them."""

    def table(held: dict, slot: int) -> dict:
        return {
            "width": pa.array(list(held), pa.int32()),
            "slot": pa.array([slot] * len(held), pa.int64()),
            "n": pa.array([h[0] for h in held.values()], pa.int64()),
            "total": _array([h[1] for h in held.values()], pa.float64()),
            "products": _array([h[2].ravel() for h in held.values()], pa.float64()),
        }

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict = {}
        for width, _, x in _blocks(batches):
            y = _centred(x, *centres[width]) @ axes[width]
            n, total, products = held.get(width, (0, 0.0, 0.0))
            held[width] = (n + len(y), total + y.sum(axis=0), products + y.T @ y)
        if held:
            yield pa.record_batch(table(held, TaskContext.get().partitionId()))

    def combine(key: tuple, part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: (r["n"], r["total"]))
        sums = [sum(r["n"] for r in rows), *(np.sum([r[c] for r in rows], axis=0) for c in ("total", "products"))]
        return pa.table(table({key[0].as_py(): sums}, key[1].as_py()))

    found = _tree(fit.select("x").mapInArrow(scan, _MATRIX), slots, combine, _MATRIX, "whitening-products")
    out = {}
    for row in found.to_pylist():
        mean = np.array(row["total"]) / row["n"]
        out[row["width"]] = np.array(row["products"]).reshape(len(mean), -1) / row["n"] - np.outer(mean, mean)
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, from whole numbers where they fit."""
    if len(x) and int(np.abs(x).max()) * n * 2 < 1 << 62:
        return (x * n - np.array(sums, np.int64)) / n
    return x.astype(float) - np.array([s / n for s in sums])


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum of (n x - S)^2 over the dimensions of each row; null beyond 64 bits."""
    most = n * max(1, int(np.abs(x).max())) + max(abs(s) for s in sums) if len(x) else 0
    if most * most * x.shape[1] < 1 << 63:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return [e if e < 1 << 63 else None for e in exact]


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: float = 256.0) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row's leading components.

    Entries count as ``floor(scale * entry)``; the covariance is that of the distinct vectors.
    """
    spark = vectors.sparkSession
    usable = F.size("embedding") > 0
    usable &= ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    entry = F.transform("embedding", lambda c: F.floor(F.lit(scale) * c.cast("double")))
    rows = written(vectors.select(F.col("vec_id").cast("long"), "embedding").filter(usable).select("vec_id", entry.alias("x")), "whitening-rows")
    fit = written(rows.select("x").distinct(), "whitening-fit")
    slots = fit.rdd.getNumPartitions()
    spectra = _spectra(fit, slots)
    if not spectra:
        return spark.createDataFrame([], _RESULT)

    centres = {w: (s.n, s.sums) for w, s in spectra.items()}
    bases = {w: np.linalg.qr(s.basis)[0] for w, s in spectra.items()}
    model = {}
    for width, matrix in _products(fit, slots, centres, bases).items():
        values, turn = np.linalg.eigh((matrix + matrix.T) / 2)
        leading = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > NO_VARIANCE * np.trace(matrix)]
        if leading:
            axes = bases[width] @ turn[:, leading]
            axes /= np.linalg.norm(axes, axis=0)
            model[width] = (axes / np.sqrt(values[leading]), values[leading] / np.trace(matrix))
    if not model:
        return spark.createDataFrame([], _RESULT)
    scaled = {w: a for w, (a, _) in model.items()}
    checked = _products(fit.filter(F.size("x").isin(list(scaled))), slots, centres, scaled)
    error = max(float(np.abs(c - np.eye(len(c))).max()) for c in checked.values())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, part, x in _blocks(batches):
            if width not in model:
                continue
            (axes, explained), (n, sums) = model[width], centres[width]
            count = len(explained)
            take = pa.array(np.repeat(np.arange(len(x)), count))
            yield pa.record_batch(
                {
                    "vec_id": part.column("vec_id").take(take),
                    "component": pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()),
                    "n": pa.array(np.full(len(take), n), pa.int64()),
                    "deviation": pa.array(_deviation(x, n, sums), pa.int64()).take(take),
                    "whitened": pa.array((_centred(x, n, sums) @ axes).ravel()),
                    "explained": pa.array(np.tile(explained, len(x))),
                    "identity_error": pa.array(np.full(len(take), error)),
                }
            )

    return rows.mapInArrow(apply, _RESULT)
