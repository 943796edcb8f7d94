import numpy as np

from framekiln.llm import vectors


def plain(rows, threshold=0.93):
    """(id, links, component) by comparing all pairs."""
    unit, label = [], []
    for _, v, l in rows:
        ok = v is not None and l is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        a = np.array(v, np.float32).astype(float) if ok else None
        unit.append(a / np.linalg.norm(a) if ok else None)
        label.append(l)
    n = len(rows)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and label[i] == label[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], len(near[i]), min(rows[j][0] for j in seen), min(rows[j][0] for j in seen) == rows[i][0]))
    return sorted(out)


def made(seed=1, size=16):
    rng = np.random.default_rng(seed)
    rows = []
    for label in range(3):
        for _ in range(12):
            centre = rng.normal(size=size)
            for _ in range(rng.integers(1, 9)):
                rows.append((centre + rng.normal(size=size) * rng.choice([0.0, 0.05, 0.2]), label))
    out = [(i, [float(x) for x in v], l) for i, (v, l) in enumerate(rows)]
    n = len(out)
    odd = [None, [], [0.0] * size, [float("nan")] * size, [float("inf")] + [1.0] * (size - 1), [None] + [1.0] * (size - 1), [1.0, 2.0], [1.0, 2.0]]
    out += [(n + i, v, 0) for i, v in enumerate(odd)]
    out += [(n + 20, out[0][1], None), (n + 21, [2 * x for x in out[0][1]], 0)]
    return out


def got(frame):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in frame.collect())


def test_all_pairs(spark):
    rows = made()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert got(vectors.near_duplicates(table)) == plain(rows)
    assert got(vectors.near_duplicates(table, block=7)) == plain(rows)


def test_cells_reach_the_recall(spark):
    rows = made(2, 24)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want, found = plain(rows), got(vectors.near_duplicates(table, cell=8, block=5))
    links = sum(r[1] for r in want)
    assert all(f[1] <= w[1] for f, w in zip(found, want))
    assert sum(r[1] for r in found) >= 0.97 * links


def test_empty_and_clashing(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, node int, weight string")
    assert vectors.near_duplicates(table).collect() == []
    rows = [(1, [1.0, 0.0], 1, "n", "w"), (1, [1.0, 0.0], 1, "n", "w"), (2, [1.0, 0.01], 1, "n", "w")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string, weight string")
    assert got(vectors.near_duplicates(table)) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
