import hashlib
import re

from framekiln.llm import winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, span=10):
    out = []
    for id_, text in docs:
        w, hit, met = words(text), set(), set()
        for item, body in items:
            b = words(body)
            n = min(span, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    met.add(str(item))
        met.discard("None")
        out.append((str(id_), len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def got(frame):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect())


def items_of(odd_rows):
    text = dict(odd_rows)
    long = text[8].split()
    return [
        (1, " ".join(text[11].split()[:25])),
        (2, " ".join(long[100:112]).upper()),
        (3, " ".join(long[200:203])),
        (4, "Same row!"),
        (44, "same ROW"),
        (5, None),
        (6, "..."),
        (7, long[50]),
        (7, "second text"),
        (8, " ".join(long[300:309])),
        (9, "nothing of this occurs in any of the documents at all here"),
    ]


def test_odd_documents(spark, odd_docs, odd_rows):
    items = items_of(odd_rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(winnowing.contamination(odd_docs, bench)) == plain(odd_rows, items)
    clean = winnowing.decontaminated(odd_docs, bench)
    assert clean.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(r[0] for r in plain(odd_rows, items) if not r[5])


def test_empty_tables(spark, odd_docs, no_docs, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert got(winnowing.contamination(odd_docs, none)) == plain(odd_rows, [])
    assert winnowing.contamination(no_docs, spark.createDataFrame(items_of(odd_rows), none.schema)).collect() == []
    assert winnowing.decontaminated(odd_docs, none).count() == len(odd_rows)


def test_main_path_has_no_python(spark, odd_docs, odd_rows):
    bench = spark.createDataFrame(items_of(odd_rows), "item_id long, text string")
    plan = winnowing.contamination(odd_docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
