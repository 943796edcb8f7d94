from collections import defaultdict

from framekiln.llm import suffixes


def plain(rows, size=50):
    """(document row, word) of every word in a run of ``size`` words that occurs again."""
    seen = defaultdict(list)
    for n, (_, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        for i in range(len(w) - size + 1):
            seen[tuple(w[i : i + size])].append((n, i))
    return {(rows[n][0], k) for places in seen.values() if len(places) > 1 for n, i in places for k in range(i, i + size)}


def words(frame):
    rows = frame.collect()
    assert all(r.n_words == r.end - r.start >= 50 for r in rows)
    return {(r.doc_id, k) for r in rows for k in range(r.start, r.end)}


def test_odd_documents(odd_docs, odd_rows):
    assert words(suffixes.repeated_passages(odd_docs)) == plain(odd_rows)


def test_shared_passages(spark):
    import random

    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(30000)}"
    passages = [[word() for _ in range(rng.choice([30, 49, 50, 51, 55, 90]))] for _ in range(40)]
    rows = []
    for i in range(300):
        text = [word() for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            text += rng.choice(passages[: 1 + i % 40]) + [word() for _ in range(rng.randint(0, 30))]
        rows.append((i, " ".join(text)))
    rows += [(1000, " ".join(passages[5] + ["between"] + passages[5]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert words(suffixes.repeated_passages(docs)) == plain(rows)
    copies = suffixes.repeated_passages(spark.createDataFrame([(7, "x " * 60 + "y"), (3, "x " * 60 + "y"), (9, "z " * 10)], docs.schema)).collect()
    assert {(r.doc_id, r.first_doc, r.n_words) for r in copies} == {(7, 3, 61), (3, 3, 61)}


def test_passages_between_many_that_agree_further_right(spark):
    """Two documents share 50 words; ``others`` share only the last 32 of them and sort between the two."""
    import random

    for others in (10, 17, 30, 300):
        rng = random.Random(others)
        word = lambda: f"v{rng.randrange(1 << 40)}"
        passage = [word() for _ in range(50)]
        rows = [(i, " ".join([word() for _ in range(20)] + passage + [f"{'az'[i]}{word()}" for _ in range(20)])) for i in (0, 1)]
        rows += [(10 + i, " ".join([word() for _ in range(20)] + passage[18:] + [f"m{word()}" for _ in range(20)])) for i in range(others)]
        rows += [(5000 + i, " ".join([word() for _ in range(20)] + passage[: 20 + i] + [word() for _ in range(20)])) for i in range(30)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert words(suffixes.repeated_passages(docs)) == plain(rows)


def test_windows_across_range_edges(spark):
    """One k-gram shared by all documents fills several partitions; passages reach left, right or to both sides of it."""
    import random

    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(1 << 40)}"
    core = [word() for _ in range(32)]
    lefts, rights = ([[word() for _ in range(24)] for _ in range(8)] for _ in range(2))
    rows = []
    for i in range(600):
        a, b = rng.randint(0, 24), rng.randint(0, 24)
        left = [word() for _ in range(24 - a)] + rng.choice(lefts)[24 - a :]
        rows.append((i, " ".join([word() for _ in range(12)] + left + core + rng.choice(rights)[:b] + [word() for _ in range(40 - b)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert words(suffixes.repeated_passages(docs)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_words_with_control_characters(spark):
    tail = " ".join(f"t{i}" for i in range(49))
    rows = [(1, "a " + tail), (2, "a\x01b " + tail), (3, "a " + tail), (4, "\x00 " + tail)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert words(suffixes.repeated_passages(docs)) == plain(rows)


def test_recurring_windows_equal_plain_pairs():
    import random

    rng = random.Random(2)
    code = sorted(rng.choice([3, 3, 3, 7, 9]) for _ in range(120))
    left, right = ([[rng.choice("ab") for _ in range(rng.randint(0, 6))] for _ in code] for _ in range(2))
    fewest, most, partner = suffixes.recurring(code, left, right, 6)
    for i in range(len(code)):
        whole = {r for r in range(7) if len(right[i]) >= r and len(left[i]) >= 6 - r}
        alike = lambda j, r: code[i] == code[j] and left[i][: 6 - r] == left[j][: 6 - r] and right[i][:r] == right[j][:r] and len(right[j]) >= r and len(left[j]) >= 6 - r  # noqa: E731, B023
        own = sorted(r for r in whole if any(j != i and alike(j, r) for j in range(len(code))))
        assert (fewest[i], most[i]) == ((own[0], own[-1]) if own else (-1, -1))
        assert not own or (partner[i] != i and alike(partner[i], own[0]))


def test_no_documents(no_docs):
    assert suffixes.repeated_passages(no_docs).collect() == []


def test_windows_of_a_common_passage_are_counted_once(spark, monkeypatch):
    """Texts that share a passage and nothing else have one context, however many they are and whatever stands around it."""
    import random

    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(1 << 40)}"
    passage = [word() for _ in range(56)]
    rows = [(i, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tables = {}
    write = suffixes.written
    monkeypatch.setattr(suffixes, "written", lambda df, label: tables.setdefault(label, write(df, label)))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert words(suffixes.repeated_passages(docs)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    contexts = tables["suffixes-alike"].selectExpr("size(filter(windows, w -> w IS NOT NULL)) AS n").agg({"n": "sum"}).first()[0]
    assert 0 < contexts < 1000


def test_words_before_and_after_a_gram_are_told_apart(spark):
    """Many texts go on with the words that one text, or two, have before the common k-gram."""
    import random

    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(1 << 40)}"
    while True:
        gram, beside = [word() for _ in range(32)], [word() for _ in range(18)]
        before, after = beside + gram, gram + beside
        around = lambda own: " ".join([word() for _ in range(20)] + own + [word() for _ in range(20)])
        _, at, _ = suffixes.sampled([around(before).encode(), around(after).encode()], 32, 19)
        if {38, 20} <= set(at.tolist()):
            break
    conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for few in (1, 2):
            rows = [(i, around(before if i < few else after)) for i in range(300)]
            docs = spark.createDataFrame(rows, "doc_id long, text string")
            want = plain(rows)
            assert 0 not in {i for i, _ in want} if few == 1 else {(0, 20), (1, 20)} <= want
            assert words(suffixes.repeated_passages(docs)) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", conf)
