import numpy as np
import pytest

from framekiln.llm import negatives


def plain(rows, is_anchor, positives=5, count=10, low=30, high=90):
    """The same by scoring every pair."""
    own = []
    for i, label, v in rows:
        if i is None or label is None or v is None or not all(c is not None and np.isfinite(c) for c in v):
            continue
        x = [int(np.floor(256.0 * float(np.float32(c)))) for c in v]
        if sum(c * c for c in x) < 2**56:
            own.append((i, label, x))
    out = []
    for a in {(i, label, tuple(x)) for i, label, x in own if is_anchor(i)}:
        scored = [(-sum(p * q for p, q in zip(a[2], x)), i, label) for i, label, x in own if i != a[0] and len(x) == len(a[2])]
        scored.sort(key=lambda s: s[:2])
        for s, p, _ in [s for s in scored if s[2] == a[1]][:positives]:
            fits = [t for t in scored if t[2] != a[1] and low * -s <= 100 * -t[0] <= high * -s]
            out += [(a[0], p, r + 1, t[1], -s, -t[0]) for r, t in enumerate(fits[:count])]
    return sorted(out)


def made(seed, count=240, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = []
    for i in range(count):
        v = centres[rng.integers(6)] + rng.normal(size=width) * rng.choice([0.1, 0.6])
        rows.append((i, int(rng.integers(4)), [float(c) for c in v * rng.choice([0.2, 1.0, 3.0])]))
    rows += [(count + i, int(i % 3), rows[10][2]) for i in range(120)]  # one vector with a third of the rows
    n = 2 * count
    rows += [(n, 1, None), (n + 1, None, rows[0][2]), (n + 2, 1, [float("nan")] * width), (n + 3, 1, [None] * width), (None, 1, rows[0][2])]
    rows += [(n + 5 * k, k % 2, [0.0] * width) for k in range(1, 5)] + [(n + 50 + i, i % 2, [1.0, float(i)]) for i in range(12)]
    rows += [(n + 70, 0, []), (n + 71, 1, []), (n + 75, 0, []), (n + 80, 1, [1e30] * width), rows[20], rows[21], (30, 3, rows[5][2])]
    return rows


def table(spark, rows):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, label, v) for i, label, v in rows], "vec_id long, label int, embedding array<float>")
    return frame.withColumns({c: F.lit("own") for c in ("x", "norm", "cell", "part", "group", "anchor", "place", "rank", "score", "asks")})


def got(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("seed,sizes", [(1, {}), (2, {"per_block": 25, "per_group": 7, "run": 5}), (3, {"per_block": 60, "per_group": 20, "run": 16})])
def test_equals_all_pairs(spark, seed, sizes):
    from pyspark.sql import functions as F

    rows = made(seed)
    result = got(negatives.mined(table(spark, rows), F.col("vec_id") % 5 == 0, **sizes))
    assert result == plain(rows, lambda i: i % 5 == 0) and len(result) > 500


def test_other_settings_and_labels_of_text(spark):
    from pyspark.sql import functions as F

    rows = made(4, 80)
    frame = table(spark, rows).withColumn("label", F.col("label").cast("string"))
    result = got(negatives.mined(frame, F.col("vec_id") < 40, positives=2, negatives=3, low=-50, high=120, per_block=30))
    assert result == plain(rows, lambda i: i < 40, 2, 3, -50, 120)


def test_empty(spark):
    from pyspark.sql import functions as F

    frame = table(spark, made(5, 30))
    assert negatives.mined(frame.filter("false"), F.lit(True)).collect() == []
    assert negatives.mined(frame, F.lit(None).cast("boolean")).collect() == []
    assert negatives.mined(frame.filter("vec_id = 3"), F.lit(True)).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(size=(400, 12)) * 100)
    x[:5], x[5:10] = 0, x[10]
    x[20] = -x[21]
    norm = np.linalg.norm(x, axis=1)
    angle = negatives.angles_to(x, norm, negatives.references(x)).astype(np.float32).astype(float)
    lower, upper = negatives.score_bounds(angle, norm, angle, angle, norm, norm)
    scores = x @ x.T
    assert (lower <= scores).all() and (scores <= upper).all()
    near = np.argsort(angle[:, 0])[:50]
    lower, upper = negatives.score_bounds(angle, norm, angle[near].min(axis=0)[None], angle[near].max(axis=0)[None], norm[near].min(keepdims=True), norm[near].max(keepdims=True))
    assert (lower <= scores[:, near]).all() and (scores[:, near] <= upper).all()
