import numpy as np
import pytest

from framekiln.llm import whitening
from framekiln.llm.whitening import Spectrum, rank_one


def made(seed=1, count=300, width=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(count, width)) @ rng.normal(size=(width, width)) * 0.3 + rng.normal(size=width)
    rows = [(i, [float(np.float32(v)) for v in x]) for i, x in enumerate(base)]
    rows += [(1000 + i, rows[5][1]) for i in range(100)]  # one vector with a large share of the rows
    rows += [(7, rows[7][1]), (None, rows[9][1]), (2000, None), (2001, [None] * width), (2002, [float("nan")] * width)]
    rows += [(2003, [float("inf")] + [0.0] * (width - 1)), (2004, []), (2005, [-0.0] * width)]
    return rows


def plain(rows, width):
    """Result by one eigendecomposition of the whole covariance."""
    own = [(i, v) for i, v in rows if v and len(v) == width and all(c is not None and np.isfinite(c) for c in v)]
    x = [tuple(int(np.floor(256 * c)) for c in v) for _, v in own]
    fit = np.array(sorted(set(x)), dtype=np.int64)
    n, total = len(fit), fit.sum(axis=0)
    centred = (n * fit - total) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    out = []
    for (i, _), row in zip(own, x):
        d = n * np.array(row) - total
        for c in range(1, 5):
            out.append((i, c, n, int((d**2).sum()), d / n @ axes[:, -c] / np.sqrt(values[-c]), values[-c] / np.trace(cov)))
    return out


def table(spark, rows):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return frame.withColumns({c: F.lit("own") for c in ("x", "n", "width", "slot", "component", "label")})


def by_key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


@pytest.mark.parametrize("parts", [1, 20])
def test_equals_one_decomposition(spark, parts):
    rows = made()
    got = by_key(tuple(r) for r in whitening.whitened(table(spark, rows).repartition(parts)).collect())
    want = by_key(plain(rows, 12))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for c in range(1, 5):
        g, w = (np.array([r[4] for r in rs if r[1] == c]) for rs in (got, want))
        sign = np.sign(g @ w)
        assert np.abs(g * sign - w).max() < 1e-9
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-10)
    assert max(r[6] for r in got) < 1e-9


def test_widths_apart_and_few_dimensions(spark):
    rows = made(2, 80, 6) + [(5000 + i, [float(i), float(i * i % 7)]) for i in range(20)] + [(6000, [1.0, 2.0, 3.0])]
    got = [tuple(r) for r in whitening.whitened(table(spark, rows)).collect()]
    want = [r for r in plain(rows, 6)]
    assert sorted(r[:4] for r in got if r[0] is not None and r[0] < 5000) == sorted(r[:4] for r in want if r[0] is not None)
    assert sum(5000 <= (r[0] or 0) < 6000 for r in got) == 40
    assert not [r for r in got if r[0] == 6000]  # a single vector has no variance


def test_large_entries(spark):
    rows = [(i, [float(2.0 ** (50 + i)), float(i), 1.0]) for i in range(8)]
    got = [tuple(r) for r in whitening.whitened(table(spark, rows)).collect()]
    x = [[int(256 * v) for v in r[1]] for r in rows]
    total = [sum(c) for c in zip(*x)]
    exact = [sum((8 * v - s) ** 2 for v, s in zip(row, total)) for row in x]
    assert {r[0]: r[3] for r in got} == {i: (e if e < 1 << 63 else None) for i, e in enumerate(exact)}


def test_empty(spark):
    frame = whitening.whitened(table(spark, made()).filter("false"))
    assert frame.collect() == [] and frame.columns[:2] == ["vec_id", "component"]
    assert whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_updates_and_combination(seed):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(size=(120, 10)) * np.logspace(0, 3, 10)).astype(np.int64)
    x[:, 4] = 0
    x[30:60] = x[0]
    parts = [Spectrum(10) for _ in range(4)]
    for part, rows in zip(parts, np.array_split(x, 4)):
        part.add(rows)
    for part in parts[1:]:
        parts[0].join(part)
    parts[0].join(Spectrum(10))
    s, centred = parts[0], x - x.mean(axis=0)
    scatter = centred.T @ centred
    assert s.n == 120 and s.sums == x.sum(axis=0).tolist() and np.allclose(s.mean, x.mean(axis=0))
    assert np.abs(s.basis.T @ s.basis - np.eye(10)).max() < 1e-12
    assert np.abs(s.basis * s.spread @ s.basis.T - scatter).max() < 1e-3 * np.abs(scatter).max()


def test_deflation():
    spread, basis = rank_one(np.zeros(6), np.eye(6), np.arange(6.0), 0.5)
    assert np.allclose(spread, [0, 0, 0, 0, 0, 27.5]) and np.allclose(basis * spread @ basis.T, 0.5 * np.outer(range(6), range(6)))
    same = rank_one(spread, basis, np.zeros(6), 1.0)
    assert same[0] is spread and same[1] is basis
