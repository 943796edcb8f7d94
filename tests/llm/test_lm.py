import math
import zlib
from collections import Counter

import numpy as np
import pytest

from framekiln.llm import lm


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def plain(rows):
    """Exact counts, and the model's score from them without the filter."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    train = [tokens(t) for (_, t), h in zip(rows, held) if not h]
    one, two = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([b"<", *t], t))
    heads, total, kinds = len(train), sum(one.values()), len(one)
    out = []
    for (id_, text), h in zip(rows, held):
        t = tokens(text)
        base = sum(math.log10((one[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t)
        score = 0.0
        for a, w in zip([b"<", *t], t):
            p = (one[w] or kinds) / (total + kinds)
            context = heads if a == b"<" else one[a]
            score += math.log10((two[a, w] + lm.PRIOR * p) / (context + lm.PRIOR))
        out.append((str(id_), h, len(t), sum(one[w] > 0 for w in t), total, base, score))
    return sorted(out)


def got(frame):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in frame.collect())


def same(a, b, close):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:5] == y[:5]
        assert x[5] == pytest.approx(y[5], abs=1e-6)
        assert x[6] == pytest.approx(y[6], rel=close, abs=0.05)


def test_odd_documents(odd_docs, odd_rows):
    same(got(lm.scored(odd_docs)), plain(odd_rows), 0.15)


def test_turns_and_joined_words_change_nothing(odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 4096)
    want = got(lm.scored(odd_docs))
    assert len(want) == len(odd_rows)
    monkeypatch.setattr(lm, "FREQUENT", 50)
    same(got(lm.scored(odd_docs, turn_bytes=6000)), want, 1e-6)


def test_fine_levels_reach_exact_counts(odd_docs, odd_rows):
    same(got(lm.scored(odd_docs, base=1.05)), plain(odd_rows), 0.01)


def test_no_documents(no_docs):
    assert lm.scored(no_docs).collect() == []


def test_filter_never_lowers_a_count(spark):
    texts = ["a b c " * n for n in (1, 2, 5, 40, 900)] + [f"w{i} w{i % 7}" for i in range(3000)]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = lm.bloom_filter(train, 4, 2).collect()
    turn = lm.Turn(4, rows)
    grams, _ = lm.ngrams([t.encode() for t in texts], 2)
    high = 0
    for g in grams:
        value, count = np.unique(g, return_counts=True)
        level, true = turn.levels(value).astype(int), lm._quantised(count, lm.LEVEL_BASE)
        assert (level >= true).all()
        high += (level > true).sum()
        absent = turn.levels(lm.mixed(value + np.uint64(99)))
        assert (absent > 0).mean() < 0.05
    assert high < 0.05 * sum(len(np.unique(g)) for g in grams)


def test_each_different_ngram_is_probed_once(monkeypatch):
    import numpy as np

    rows = [{"bucket": 0, "bits": b"\xff" * 8}, {"bucket": 1, "bits": bytes([0b10110111] * 64)}]
    turn = lm.Turn(3, rows[1:])
    hashes = np.random.default_rng(5).integers(1 << 62, size=50, dtype=np.uint64) * np.uint64(4)
    want = turn.levels(hashes)
    probed = []
    steps = lm._steps
    monkeypatch.setattr(lm, "_steps", lambda own, level: probed.append(len(own)) or steps(own, level))
    assert np.array_equal(turn.levels(np.tile(hashes, 40)), np.tile(want, 40))
    assert want.any() and max(probed) <= len(hashes)
    assert np.array_equal(turn.levels(hashes[:0]), want[:0])


def test_tables_hold_no_texts_however_many_buckets_there_are(odd_docs, odd_rows, monkeypatch):
    """What a run writes does not grow with the number of buckets, and texts are not among it."""
    tables = []
    written = lm.written
    monkeypatch.setattr(lm, "written", lambda df, label, *rest: tables.append((label, tuple(df.columns))) or written(df, label, *rest))
    monkeypatch.setattr(lm, "PART_BYTES", 1 << 14, raising=False)
    monkeypatch.setattr(lm, "FREQUENT", 50)
    few = got(lm.scored(odd_docs))
    first, tables[:] = list(tables), []
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 4096)
    many = got(lm.scored(odd_docs, turn_bytes=6000))
    assert tables == first and not any({"text", "levels"} & set(columns) for _, columns in tables)
    same(few, plain(odd_rows), 0.15)
    same(many, plain(odd_rows), 0.15)


def test_rows_that_recur_often(spark):
    """Counts above a byte, of copies too, and as many rows as came."""
    rows = [(1, "same words here")] * 900 + [(2, "other words " * 400)] * 3 + [(i, f"w{i} words") for i in range(3, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(got(lm.scored(docs, base=1.05)), plain(rows), 0.1)
