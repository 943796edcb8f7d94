import hashlib
import random
import re

import numpy as np

from framekiln.llm import pii
from framekiln.llm.boosting import Trees


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def plain(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


TEXTS = [
    "a.b@c.de x@y z@w.x.y. 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 é +49 (0) 30 1234567 4111 1111 1111 1111 end",
    "mail bob@@c.d a@b@c.d.e +1-800-555-0199 +12 34 4111-1111-1111-1112 1.2.3 9.9.9.9",
    "\U0001f600 x@y.zz 10.0.0.1, +4912345678901234567 4111 1111 1111 1111 5555555555554444",
    "5555555555554444" * 40,
    "1." * 500,
    "+" * 300 + "1 2 3 4 5 6 7 8 9 0",
    "@" * 100 + "a@b.c",
]


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    alphabet = "a1 .@+-()4 5x9_%é\n"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(3000)]
    for text in texts:
        assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 100_000, "a." * 100_000 + "@"):
        pii.base_spans(text)
        pii.candidates(text)


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_odd_documents(spark, odd_docs, odd_rows):
    rows = odd_rows + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(rows[len(odd_rows) :], "doc_id long, text string"))
    want = sorted((str(i), hashlib.sha256(joined(plain(t or "")).encode()).hexdigest(), *(sum(x[1] == k for x in plain(t or "")) for k in range(4))) for i, t in rows)
    found = pii.detect(docs).collect()
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in found) == want
    texts = {i: t for i, t in rows}
    for r in found:
        if r.doc_id is not None and r.doc_id >= 1000:
            assert set(joined(plain(texts[r.doc_id])).split(",")) <= set(r.spans.split(","))


def test_redaction_keeps_other_columns(spark, odd_docs, odd_rows):
    out = pii.redacted(odd_docs)
    assert out.columns == odd_docs.columns
    rows = out.collect()
    assert len(rows) == len(odd_rows) and all(r.key == "own key" and r.x == "own x" for r in rows)
    one = spark.createDataFrame([(1, "write to é a.b@c.de, +49 30 1234567 or 10.0.0.1.", 5)], "doc_id long, text string, n long")
    assert pii.redacted(one).collect()[0].text == "write to é [EMAIL], [PHONE] or [IP]."


def test_no_documents(no_docs):
    assert pii.detect(no_docs).collect() == []
    assert pii.redacted(no_docs).collect() == []


def test_trees_add_spans_that_look_right(spark):
    """Numbers without a plus sign in the place of phone numbers are added; other numbers are not."""
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        number = f"({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
        kind = i % 3
        text = f"please call +1 {number} now" if kind == 0 else f"order no {rng.randint(10**7, 10**8 - 1)}/{rng.randint(1, 9)}" if kind == 1 else "plain words only"
        rows.append((i, text))
    rows += [(5000, "please call 1 (222) 555-1234 now"), (5001, "order no 12345678/9")]
    spans = {r.doc_id: r.spans for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[5000].startswith("phone:12:") and spans[5001] == "" and spans[1] == "" and spans[2] == ""


def people(rng, i):
    """A text with personal data in its exact form, a look-alike, or none."""
    digits = "".join(str(rng.randint(0, 9)) for _ in range(15))
    card = next(digits + str(c) for c in range(10) if luhn(digits + str(c)))
    off = card[:-1] + str((int(card[-1]) + 1 + i % 8) % 10)
    return [
        f"please call +{rng.randint(1, 99)} ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)} now",
        f"write to n{i}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com today",
        f"login from {rng.randint(100, 255)}.{rng.randint(100, 255)}.{rng.randint(10, 255)}.{rng.randint(10, 255)} failed",
        f"paid with {card} at noon",
        f"order number {off} was late",
        f"we met at noon. Then {rng.randint(1, 9)} left",
        f"token = 'ab{rng.randint(10**8, 10**9)}fe'",
    ][i % 7]


def test_forms_that_no_pattern_has(spark):
    """Of personal data rewritten into other forms most is added, of look-alikes none."""
    rng = random.Random(8)
    rows = [(i, people(rng, i)) for i in range(2800)]
    hidden = []
    for i in range(210):
        text = people(rng, i)
        for start, kind, end in plain(text):
            forms = pii.variants(kind, text[start:end])
            form = rng.randrange(len(forms))
            hidden.append((10_000 + i, text[:start] + forms[form] + text[end:], kind))
    docs = spark.createDataFrame(rows + [h[:2] for h in hidden], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.detect(docs).collect()}
    kinds = [0] * 4
    caught = [0] * 4
    for i, text, kind in hidden:
        assert not plain(text) or kind == 1  # other forms match no exact pattern
        kinds[kind] += 1
        caught[kind] += f"{pii.KINDS[kind]}:" in found[i].spans
    assert sum(caught) >= 0.8 * sum(kinds) and all(c > 0 for c in caught)
    assert all(found[i].n_added == 0 for i in range(2800))
    whole = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    for i, _, kind in hidden:
        assert (f"[{pii.KINDS[kind].upper()}]" in whole[i]) == (f"{pii.KINDS[kind]}:" in found[i].spans)
    assert all("order number" not in whole[i] or "[" not in whole[i] for i in range(2800))


def test_variants_match_no_pattern():
    rng = random.Random(3)
    for i in range(400):
        text = people(rng, i)
        for start, kind, end in plain(text):
            for form in pii.variants(kind, text[start:end]):
                assert (start, kind, start + len(form)) not in plain(text[:start] + form + text[end:])


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    p = Trees().fit(x[:3000], y[:3000]).predict(x[3000:])
    assert ((p > 0.5) == (y[3000:] > 0)).mean() > 0.95


def examples(spark, rng):
    """60,000 examples of one kind and 120 of another, which are right if their last feature is high."""
    from pyspark.sql import functions as F

    rows = []
    for i in range(60_120):
        kind, right = (2 if i % 501 == 0 else 3), bool(i % 2)
        x = [float(kind == 2), float(rng.randint(0, 30)), float(rng.randint(0, 10**6)), float(rng.randint(5, 9) if right else rng.randint(0, 4))]
        rows.append((i // 4, i // 2 % 6 if right else -1, kind, right, x))
    flat = spark.createDataFrame(rows, "doc_id long, form int, kind int, right boolean, x array<float>")
    return flat.groupBy("doc_id").agg(F.collect_list(F.struct("form", "kind", "right", "x")).alias("examples"))


def test_all_examples_take_part(spark):
    """A kind with few of many examples has enough to be calibrated."""
    selector = pii.fit(examples(spark, random.Random(5)))
    assert selector.least[2] < 1 and selector.least[3] < 1 and selector.least[0] == selector.least[1] == 2.0
    score = selector.trees.predict(np.array([[1, 9, 500, 7], [1, 9, 500, 2]], float))
    assert score[0] >= selector.least[2] > score[1]


def test_sums_over_a_table_give_the_same_trees(spark, monkeypatch):
    found = examples(spark, random.Random(7))
    monkeypatch.setattr(pii, "Trees", lambda: Trees(trees=3))
    here = pii.fit(found)
    monkeypatch.setattr(pii, "HELD", 0, raising=False)
    there = pii.fit(found.repartition(5))
    assert here.least == there.least and len(there.trees.trees) == 3
    for a, b in zip(here.trees.trees, there.trees.trees):
        assert all(np.array_equal(x, y) for x, y in zip(a, b))
