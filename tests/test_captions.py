import random

import pytest
from pyspark.sql import functions as F

from framekiln.functions import captions as C

SCHEMA = f"tagged {C.TAGGED.replace(': ', ':')}"


def row(words, entities=()):
    pairs = [w.rsplit("/", 1) for w in words.split()] if words else []
    return ([w for w, _ in pairs], [t for _, t in pairs], [e for e, _ in entities], [k for _, k in entities])


def compressed(spark, rows, **options):
    df = spark.createDataFrame([(r,) for r in rows], SCHEMA).withColumn("id", F.monotonically_increasing_id())
    return [r.c for r in df.select("id", C.compress_caption(F.col("tagged"), **options).alias("c")).orderBy("id").collect()]


GOLDENS = [
    # An adjective waits across other words.
    ("Big/ADJ and/CCONJ red/ADJ is/AUX the/DET Dog/NOUN", (), "big red dog"),
    # Adjectives without a noun are lost.
    ("dog/NOUN is/AUX happy/ADJ", (), "dog"),
    # A rejected phrase goes, a longer phrase with the same word stays.
    ("image/NOUN red/ADJ image/NOUN camera/NOUN", (), "red image"),
    # Equal phrases are said once, at their first place.
    ("cat/NOUN dog/NOUN cat/NOUN", (), "cat, dog"),
    ("", (), ""),
    # Parts of a name stand for the whole name, once.
    ("Bob/PROPN Williams/PROPN runs/VERB", (("Bob Williams", "PERSON"),), "bob williams"),
    # Other kinds of entities do not count.
    ("Paris/PROPN streets/NOUN", (("Paris streets", "GPE"),), "paris, streets"),
    # Adjectives before a repeated name stay for the next noun.
    (
        "tall/ADJ Bob/PROPN Williams/PROPN old/ADJ Bob/PROPN hat/NOUN",
        (("Bob Williams", "PERSON"),),
        "tall bob williams, old hat",
    ),
    # A waiting adjective does not count as said.
    ("bob/ADJ Bob/PROPN", (("Bob", "PERSON"),), "bob bob"),
    # A name inside an earlier, longer noun counts as said.
    ("bobcat/NOUN Bob/PROPN tree/NOUN", (("Bob", "ORG"),), "bobcat, tree"),
]


def test_goldens(spark):
    got = compressed(spark, [row(w, e) for w, e, _ in GOLDENS])
    assert got == [want for _, _, want in GOLDENS]


def test_class_label(spark):
    rows = [row("black/ADJ dog/NOUN dog/NOUN hotdog/NOUN")]
    assert compressed(spark, rows, label="dog", identifier="sks") == ["black sks dog, sks dog, hotsks dog"]


def plain(words, tags, entities, labels):
    """The phrase rules, one word at a time."""
    names = [e.lower() for e, k in zip(entities, labels) if k in ("PERSON", "ORG")]
    said, waiting = [], []
    for word, tag in zip((w.lower() for w in words), tags):
        if tag == "ADJ":
            waiting.append(word)
        elif tag in ("NOUN", "PROPN"):
            name = next((n for n in names if word in n), None)
            if name is not None and any(name in p for p in said):
                continue
            said.append(" ".join([*waiting, name or word]))
            waiting = []
    return said


@pytest.mark.parametrize("seed", range(3))
def test_phrases_equal_the_plain_rules(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "ab", "ba", "abc", "cab", "c", "bc", "Bca"]
    rows = []
    for _ in range(150):
        n = rng.randrange(0, 15)
        words = [rng.choice(vocabulary) for _ in range(n)]
        tags = [rng.choice(["ADJ", "NOUN", "PROPN", "X"]) for _ in range(n)]
        k = rng.randrange(0, 4)
        entities = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 2))) for _ in range(k)]
        rows.append((words, tags, entities, [rng.choice(["PERSON", "ORG", "GPE"]) for _ in range(k)]))
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"id int, {SCHEMA}")
    got = df.select("id", C.phrases(F.col("tagged")).alias("p")).orderBy("id").collect()
    assert [r.p for r in got] == [plain(*r) for r in rows]


def test_tagger_is_loaded_once_per_task(spark):
    def factory():
        calls = []

        def tag(caption):
            calls.append(caption)
            words = caption.split()
            return words, ["NOUN"] * len(words), [str(len(calls))], ["ORG"]

        return tag

    df = spark.createDataFrame([("one two",), ("three",), (None,)], "c string").coalesce(1)
    got = [r.t for r in df.select(C.tag_tokens(factory)(F.col("c")).alias("t")).collect()]
    assert got[0].words == ["one", "two"] and got[1].entities == ["2"] and got[2].words == []


def test_small_edits(spark):
    df = spark.createDataFrame([("",), ("a red car",)], "c string")
    got = df.select(C.remove_word(F.col("c"), "red "), C.caption_guard(F.col("c"), F.lit("x"))).collect()
    assert [tuple(r) for r in got] == [("", ""), ("a car", "x")]


def test_marks_in_words_are_dropped(spark):
    row = (["big\u0001", "d\u0002og"], ["ADJ", "NOUN"], [], [])
    tagged = spark.createDataFrame([(row,)], f"t {C.TAGGED}")
    assert tagged.select(C.phrases(F.col("t")).alias("p")).first().p == ["big dog"]
