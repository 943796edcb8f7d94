import numpy as np
import pytest
import xxhash

from framekiln.llm import simhash
from framekiln.llm.common import components


def plain_fingerprint(text, words=3):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(pairs, close):
    """Smallest id reachable by links, for (id, value) pairs."""
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if close(pairs[i][1], pairs[j][1]):
                root[find(i)] = find(j)
    ids = {}
    for i, (id_, _) in enumerate(pairs):
        if id_ is not None:
            ids[find(i)] = min(ids.get(find(i), id_), id_)
    return [ids.get(find(i)) for i in range(len(pairs))]


def test_odd_documents(odd_docs, odd_rows):
    rows = [(i, plain_fingerprint(t)) for i, t in odd_rows]
    groups = plain_groups(rows, lambda a, b: (a ^ b).bit_count() <= 3)
    want = sorted((str(i), fp, g) for (i, fp), g in zip(rows, groups))
    got = sorted((str(r.doc_id), r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(odd_docs).collect())
    assert got == want


def test_no_documents(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.without_near_duplicates(no_docs).collect() == []


def test_crowded_nodes(spark):
    """Fingerprints in a small ball: nodes are cut again until they are small, and no link is lost."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    values = {base}
    for _ in range(1500):
        values.add(base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 9), replace=False)))
    values |= {int(v) for v in rng.integers(1 << 62, size=500)}
    pairs = [(simhash._signed(v), v) for v in sorted(values)]
    fps = spark.createDataFrame([(p[0],) for p in pairs], "fp long")
    groups = plain_groups(pairs, lambda a, b: (a ^ b).bit_count() <= 3)
    for limit in (40, 4096):
        roots = {r.node: r.root for r in components(simhash.linked(fps, 3, limit)).collect()}
        assert [roots.get(p[0], p[0]) for p in pairs] == groups


def test_gray_links_prune_and_join_groups():
    rng = np.random.default_rng(8)
    fp = np.unique(np.concatenate([np.arange(400, dtype=np.uint64), rng.integers(1 << 62, size=300, dtype=np.uint64)]))
    root = simhash.gray_links(fp[:, None], 3)
    want = plain_groups([(i, int(v)) for i, v in enumerate(fp)], lambda a, b: (a ^ b).bit_count() <= 3)
    groups = {}
    for r, w in zip(root.tolist(), want):
        assert groups.setdefault(r, w) == w
    assert len(groups) == len(set(want))


def jaccard(a, b, words=5):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_groups_match_exact_similarity(spark):
    import random

    rng = random.Random(2)
    rows = []
    for number in range(60):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(40, 200))]
        for _ in range(rng.randint(1, 5)):
            changed = list(words)
            for at in rng.sample(range(len(words)), rng.randint(0, max(1, len(words) // 40))):
                changed[at] = f"w{rng.randrange(4000)}"
            rows.append((len(rows), " ".join(changed)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    want = plain_groups(rows, lambda a, b: jaccard(a, b) >= 0.8)
    assert [got[i] for i, _ in rows] == want
    kept = simhash.without_near_duplicates(docs.union(docs.limit(30))).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))


def test_without_near_duplicates_keeps_columns(odd_docs):
    kept = simhash.without_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and 11 in ids and 12 not in ids and ids.count(5) <= 2 and 1 in ids and 2 not in ids


def test_similar_groups_link_families_of_close_copies(spark):
    """Each text has five closer copies than the nearest text of the other family, which is similar enough as well."""
    rows = []
    for number in range(8):
        words = [f"n{number}w{i}" for i in range(200)]
        other = words[:90] + [f"n{number}o{i}" for i in range(13)] + words[103:]
        rows += [(len(rows) + i, " ".join([*family, f"n{number}v{j}"])) for i, (family, j) in enumerate((f, j) for f in (words, other) for j in range(6))]
    want = plain_groups(rows, lambda a, b: jaccard(a, b) >= 0.8)
    assert len(set(want)) == 8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert [got[i] for i, _ in rows] == want


def test_similar_groups_tell_texts_with_one_common_line_apart(spark):
    """One line fifty times and another end: equal majorities of repeated shingles, but few shared shingles."""
    line = " ".join(f"l{i}" for i in range(11))
    rows = [(i, "\n".join([line] * 50 + [" ".join(f"d{i}e{j}" for j in range(28))])) for i in range(6)]
    rows += [(6, rows[0][1] + "\n" + line), (7, rows[0][1].upper())]
    want = plain_groups(rows, lambda a, b: jaccard(a, b) >= 0.8)
    assert want == [0, 1, 2, 3, 4, 5, 0, 0]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()} == dict(enumerate(want))


def test_without_near_duplicates_keeps_one_row_of_each_group(spark, odd_docs):
    """Ids that are missing or stand on unlike texts do not make them copies."""
    kept = [(r.doc_id, r.text) for r in simhash.without_near_duplicates(odd_docs).collect()]
    assert kept.count((5, "first text")) == kept.count((5, "second text of one id")) == 1
    rows = [(None, "a clean text"), (None, "another one that is unlike"), (None, "another one that is unlike"), (None, "a clean  Text"), (None, "third")]
    rows += [(1, "some words"), (1, "other words here"), (1, "Some words"), (2, "some words"), (None, "other words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r.doc_id), " ".join(r.text.lower().split())) for r in simhash.without_near_duplicates(docs).collect())
    assert kept == [("1", "other words here"), ("1", "some words"), ("None", "a clean text"), ("None", "another one that is unlike"), ("None", "third")]


def test_short_texts_at_the_threshold(spark):
    """Pairs whose shingles just reach 0.8 or just don't: one word more at the end or begin, one exchanged, or two more."""
    import random

    rng = random.Random(1)
    rows = []
    for number in range(400):
        words = [f"s{rng.randrange(10**6)}" for _ in range((5, 8, 9, 10, 13, 14, 15, 17)[number % 8])]
        other = [[*words, "more"], [*words[:-1], "other"], [*words, "two", "more"], ["first", *words]][number // 8 % 4]
        rows += [(2 * number, " ".join(words)), (2 * number + 1, " ".join(other))]
    sets = {}
    for i, text in rows:
        w = text.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    by_shingle = {}
    for i, own in sets.items():
        for x in own:
            by_shingle.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in by_shingle.values() for a in ids for b in ids if a < b}
    want = plain_roots(len(rows), [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert [got[i] for i, _ in rows] == want and 500 < len(set(want)) < 700


def test_large_group_gives_few_candidates():
    """A run of near copies gives a forest, and nothing once they are one group."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    fp = np.repeat(rng.integers(1 << 62, size=(1, 4), dtype=np.uint64), 900, axis=0)
    for row in fp:
        for bit in rng.integers(256, size=4):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    order = np.lexsort(fp.T[::-1])
    fp, ids = fp[order], np.arange(900)

    def found(root, most):
        columns = {"mask": np.zeros(900, np.int64), "pattern": np.zeros(900, np.int64), "id": ids, "root": root}
        columns |= {f"f{i}": fp[:, i].copy().view(np.int64) for i in range(4)}
        out = list(simhash._nearest(iter([pa.record_batch({k: pa.array(v) for k, v in columns.items()})]), 50, [f"f{i}" for i in range(4)], 1024, most))
        return [r for b in out for r in b.to_pylist()]

    single = found(ids, 0)
    pairs = [(r["a"], r["b"]) for r in single if r["b"] is not None]
    assert len(pairs) == 899 and len(set(plain_roots(900, pairs))) == 1
    assert found(np.zeros(900, np.int64), 0) == [] == found(np.zeros(900, np.int64), 4)
    halves = found(ids % 2, 0)
    assert len([r for r in halves if r["b"] is not None]) == 1 and sorted(r["a"] for r in halves if r["b"] is None) == [0, 1]
    assert len([r for r in found(ids % 2, 1) if r["b"] is not None]) <= 1800


def plain_roots(count, pairs):
    root = list(range(count))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(count)]


def families(rng, count):
    rows = []
    for number in range(count):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(40, 200))]
        for _ in range(rng.randint(1, 5)):
            changed = list(words)
            for at in rng.sample(range(len(words)), rng.randint(0, max(1, len(words) // 40))):
                changed[at] = f"w{rng.randrange(4000)}"
            rows.append((len(rows), " ".join(changed)))
    return rows


def test_long_nodes_and_clusters_lose_nothing(spark, monkeypatch):
    """Runs, tiles and cells of a few entries each: every two entries of a node are still compared."""
    import random

    rng = random.Random(2)
    rows = families(rng, 60)
    base = [f"n{i}" for i in range(120)]
    for _ in range(40):  # one node: copies below and above the similarity
        changed = list(base)
        for at in rng.sample(range(120), rng.randint(1, 4)):
            changed[at] = f"v{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(changed)))
    want = plain_groups(rows, lambda a, b: jaccard(a, b) >= 0.8)
    for name, value in (("RUN", 2), ("TILE", 7), ("CELL_BYTES", 8000)):
        monkeypatch.setattr(simhash, name, value, raising=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert [got[i] for i, _ in rows] == want


def test_pairs_far_apart_in_a_long_node_are_connected():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    fp = rng.integers(1 << 62, size=(1500, 4), dtype=np.uint64)
    fp = np.concatenate([fp, fp ^ np.array([1 << 61, 0, 3, 0], np.uint64)])
    order = np.argsort(fp[:, 0], kind="stable")
    ids = np.arange(3000)[order]
    columns = {"mask": np.zeros(3000, np.int64), "pattern": np.zeros(3000, np.int64), "id": ids, "root": ids}
    columns |= {f"f{i}": fp[order, i].copy().view(np.int64) for i in range(4)}
    batch = pa.record_batch({k: pa.array(v) for k, v in columns.items()})
    parts = [f"f{i}" for i in range(4)]
    found = {(r["a"], r["b"]) for b in simhash._connected(iter([batch.slice(0, 700), batch.slice(700)]), 20, parts, 256) for r in b.to_pylist()}
    assert found == {(i, i + 1500) for i in range(1500)}
    in_runs = {(r["a"], r["b"]) for b in simhash._nearest(iter([batch]), 20, parts, 256, 0) for r in b.to_pylist() if r["b"] is not None}
    assert not in_runs


def test_cells_verify_every_pair_that_counts():
    """A cluster whose pairs lie on both sides of the similarity: groups equal brute force, in one cell and in cells of two blocks."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    base = rng.integers(1 << 62, size=100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: 100 - k], rng.integers(1 << 62, size=k, dtype=np.uint64)])) for k in rng.integers(7, 10, size=400)]
    parts, block = [f"f{i}" for i in range(4)], rng.integers(2, size=400)

    def batch(rows, blocks):
        zero = np.zeros(len(rows), np.int64)
        columns = {"mask": zero, "pattern": zero, "id": rows, "block": blocks, **{p: zero for p in parts}}
        return pa.record_batch({**{k: pa.array(v) for k, v in columns.items()}, "codes": pa.array([sets[i].tobytes() for i in rows], pa.binary())})

    def close(a, b):
        shared = len(np.intersect1d(a, b))
        return shared >= 0.8 * (len(a) + len(b) - shared) - 1e-9

    want = plain_groups(list(enumerate(sets)), close)
    every = np.arange(400)
    cells = [batch(every[block == k], np.full((block == k).sum(), -1)) for k in (0, 1)] + [batch(every, block)]
    for chosen in ([batch(every, np.full(400, -1))], cells):
        links = [(r["a"], r["b"]) for c in chosen for b in simhash._cell_links(iter([c]), 50, 0.8, parts) for r in b.to_pylist()]
        assert plain_roots(400, links) == want and len(links) <= 399 * len(chosen)
    assert 20 < len(set(want)) < 380
