"""Toxicity and quality: exact neighbours, equal matrices, held-out accuracy."""

import numpy as np
import pytest

from framekiln.llm import quality, toxicity
from framekiln.llm.common import isotonic

LABELS = "doc_id long, quality int, toxic int"


def test_block_max_finds_the_nearest():
    rng = np.random.default_rng(0)
    examples, terms = 700, 40
    dense = rng.random((examples, terms)) * (rng.random((examples, terms)) < 0.15)
    dense[::7] = dense[3]  # ties
    norm = np.linalg.norm(dense, axis=1, keepdims=True)
    dense = np.where(norm > 0, dense / np.maximum(norm, 1e-12), 0)
    example, term = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(example, term, dense[example, term], examples, terms)
    for _ in range(200):
        query = np.flatnonzero(rng.random(terms) < 0.1)
        weight = rng.random(len(query))
        score = dense[:, query] @ weight
        want = [i for i in np.lexsort((np.arange(examples), -np.round(score, 12))) if score[i] > 0][:15]
        best, cosine = index.nearest(query, weight, 15)
        assert best.tolist() == want and cosine == pytest.approx(score[want])


def test_pool_adjacent_violators():
    rng = np.random.default_rng(1)
    s, y, w = rng.random(60), rng.random(60), rng.integers(1, 5, 60).astype(float)
    knots, levels = isotonic(s, y, w)
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()
    order = np.argsort(s)
    # Minimax form of the least-squares monotone fit.
    ys, ws = y[order], w[order]
    fit = [max(min((ys[a : b + 1] * ws[a : b + 1]).sum() / ws[a : b + 1].sum() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert sorted(set(np.round(fit, 9))) == pytest.approx(sorted(set(np.round(levels, 9))))


def test_normal_equations_equal_one_matrix(spark):
    rng = np.random.default_rng(2)
    x, y, fold = rng.normal(size=(500, 5)), rng.integers(0, 2, 500), rng.integers(1, 5, 500)
    rows = [(a.tolist(), int(b), int(c)) for a, b, c in zip(x, y, fold)]
    table = spark.createDataFrame(rows, "x array<double>, y int, fold long").repartition(7)
    cosines = quality.Cosines(x.mean(0), x.std(0), features=20)
    sums = quality._summed_equations(table, cosines, 5, 5)
    z = cosines(x)
    for f in range(5):
        own = fold == f
        assert sums[f] == pytest.approx(z[own].T @ np.column_stack([z[own], y[own]]))


def test_cosines_approximate_the_kernel():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 4))
    z = quality.Cosines(np.zeros(4), np.ones(4), features=20000)(x)[:, :-1]
    distance = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-distance / 8)).max() < 0.05


def test_statistics_take_each_text_by_itself(odd_rows):
    texts = [(t or "").encode() for _, t in odd_rows]
    whole = quality.statistics(texts)
    assert np.isfinite(whole).all()
    alone = np.concatenate([quality.statistics([t]) for t in texts])
    assert whole == pytest.approx(alone)


@pytest.mark.parametrize("run", [quality.quality, toxicity.toxicity])
def test_odd_documents(spark, odd_docs, odd_rows, no_docs, run):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(100, 140)] + [(4, 1, True), (4, None, None), (None, 1, True), (999, 0, False)], "doc_id long, quality int, toxic boolean")
    labels = labels.selectExpr("doc_id", "quality", "cast(toxic as int) toxic")
    rows = run(odd_docs, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 4}) == 1
    assert run(no_docs, labels).collect() == []
    unlabelled = run(odd_docs, labels.filter("false")).collect()
    assert {r.score for r in unlabelled} == {0.5 if run is quality.quality else 0.0}


@pytest.mark.parametrize("run,target", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_held_out_accuracy(spark, run, target):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rows = run(docs, labels).join(labels, "doc_id").filter("held_out").select("predicted", target).collect()
    right = sum(r.predicted == r[target] for r in rows)
    assert len(rows) > 50 and right >= 0.9 * len(rows)


def test_held_out_labels_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    for run, folds, out in ((quality.quality, 5, 0), (toxicity.toxicity, 4, 2)):
        held = f"crc32(cast(doc_id as string)) % {folds} = {out}"
        turned = labels.selectExpr("doc_id", f"if({held}, 1 - quality, quality) quality", f"if({held}, 1 - toxic, toxic) toxic")
        a, b = ({r.doc_id: r.score for r in run(docs, x).collect()} for x in (labels, turned))
        assert a == pytest.approx(b)
