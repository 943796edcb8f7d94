"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``span`` consecutive words of an item (a shorter item is one window). For windows
of L words, k-grams of k = (L + 1) // 2 words are hashed, and of each run of w = L - k + 1
neighbouring hashes the smallest is a fingerprint. A passage of L words holds one whole run, so
a window that occurs in a document has a fingerprint there: none is missed. Fingerprints of
documents are joined with those of the items, each hit is extended to the windows around it, and
these are compared word by word with the items' windows, so none is wrong.

Only positions and hashes of documents are exploded; texts are shuffled for the documents
with hits, and not at all if the hits are small enough for Spark to broadcast. Items
of equal words are one class, so copies among them do not multiply rows.

Cases: a null text has no words; an empty text and an item without words hit nothing;
repeated rows each get the same result; an item id on several rows counts once; null item
ids are left out of the item list. With no items every count is zero.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framekiln.session import written

SPAN = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where a lambda uses it often."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lowered; null for null."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def _fingerprints(words: Column, length: int) -> Column:
    """Array of (length, at, hash): winnowed k-grams with their 1-based place."""
    k = (length + 1) // 2
    run = length - k + 1

    def place(h: Column, j: Column) -> Column:
        return _let(F.slice(h, j, run), lambda s: j - 1 + F.array_position(s, F.array_min(s)).cast("int"))

    def chosen(h: Column) -> Column:
        runs = F.sequence(F.lit(1), F.size(h) - (run - 1))
        places = F.array_distinct(F.transform(runs, lambda j: place(h, j)))
        return F.transform(places, lambda p: F.struct(F.lit(length).alias("length"), p.alias("at"), F.element_at(h, p).alias("hash")))

    def grams(codes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(codes) - (k - 1))
        return _let(F.transform(starts, lambda i: F.xxhash64(F.slice(codes, i, k))), chosen)

    empty = F.array().cast("array<struct<length:int,at:int,hash:bigint>>")
    return F.when(F.size(words) >= length, _let(F.transform(words, lambda w: F.xxhash64(w)), grams)).otherwise(empty)


def _all_fingerprints(words: Column, lengths: list[int]) -> Column:
    return _let(words, lambda w: F.concat(*[_fingerprints(w, length) for length in lengths]))


def _windows_around(words: Column, hits: Column) -> Column:
    """Array of (length, start, window) for every window that holds a hit's k-gram."""

    def around(h: Column, n: Column) -> Column:
        least = F.greatest(F.lit(1), h["at"] + F.floor((h["length"] + 1) / 2).cast("int") - h["length"])
        most = F.least(h["at"], n - h["length"] + 1)
        return F.when(least <= most, F.transform(F.sequence(least, most), lambda s: F.struct(h["length"].alias("length"), s.alias("start"))))

    def texts(w: Column) -> Column:
        starts = F.array_distinct(F.flatten(F.filter(F.transform(hits, lambda h: around(h, F.size(w))), lambda x: x.isNotNull())))
        return F.transform(
            starts,
            lambda s: F.struct(
                s["length"].alias("length"), s["start"].alias("start"), F.array_join(F.slice(w, s["start"], s["length"]), " ").alias("window")
            ),
        )

    return _let(words, texts)


def _covered(spans: Column) -> Column:
    """Words in the union of spans (start, end), end exclusive."""
    state = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("words"))
    return F.aggregate(
        F.array_sort(spans),
        state,
        lambda s, x: F.struct(
            F.greatest(s["upto"], x["end"]).alias("upto"),
            (s["words"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["upto"], x["start"]))).alias("words"),
        ),
        lambda s: s["words"],
    )


def hits(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, __key, n_hit, items): the documents that hold a window, by id and hash of their text."""
    docs = docs.select(F.col("doc_id"), F.xxhash64("text").alias("__key"), F.col("text"))
    bench = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    classes = bench.groupBy("words").agg(F.collect_set("item").alias("items"))
    classes = classes.select(F.xxhash64("words").alias("class"), "words", "items", F.least(F.lit(span), F.size("words")).alias("length"))
    classes = written(classes, "winnowing-classes")
    lengths = sorted(r["length"] for r in classes.select("length").distinct().collect())  # ``span`` at most
    if not lengths:
        nothing = docs.select("doc_id", "__key", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
        return nothing.filter(F.lit(False))

    by_length = classes.select(
        "length",
        F.explode(
            F.coalesce(*[F.when(F.col("length") == n, _fingerprints(F.col("words"), n)) for n in lengths])
        ).alias("f"),
    )
    marks = written(by_length.select(F.col("f.length").alias("length"), F.col("f.hash").alias("hash")).distinct(), "winnowing-marks")
    exploded = docs.select("doc_id", "__key", F.explode(_all_fingerprints(words_of(F.col("text")), lengths)).alias("f"))
    seen = exploded.select("doc_id", "__key", "f.*").join(marks, ["length", "hash"], "left_semi")
    seen = seen.groupBy("doc_id", "__key").agg(F.collect_set(F.struct("length", "at")).alias("hits"))
    seen = written(seen, "winnowing-hits").withColumnsRenamed({"doc_id": "__id", "__key": "__hit_key"})

    same = docs["doc_id"].eqNullSafe(seen["__id"]) & (docs["__key"] == seen["__hit_key"])
    near = docs.join(seen, same).dropDuplicates(["doc_id", "__key"])
    near = near.select("doc_id", "__key", F.explode(_windows_around(words_of(F.col("text")), F.col("hits"))).alias("w")).select("doc_id", "__key", "w.*")
    places = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    windows = classes.select(
        "class", "length", F.explode(F.transform(places, lambda s: F.array_join(F.slice("words", s, F.col("length")), " "))).alias("window")
    ).distinct()
    windows = written(windows, "winnowing-windows")
    met = near.join(windows, ["length", "window"])
    met = met.groupBy("doc_id", "__key").agg(
        F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))).alias("spans"), F.collect_set("class").alias("classes")
    )
    met = written(met.select("doc_id", "__key", _covered(F.col("spans")).alias("n_hit"), "classes"), "winnowing-met")
    named = met.select("doc_id", "__key", F.explode("classes").alias("class")).join(classes.select("class", "items"), "class")
    named = named.select("doc_id", "__key", F.explode("items").alias("item")).groupBy("doc_id", "__key").agg(F.collect_set("item").alias("items"))
    named = named.withColumnsRenamed({"doc_id": "__id", "__key": "__hit_key"})
    found = met.join(named, met["doc_id"].eqNullSafe(named["__id"]) & (met["__key"] == named["__hit_key"]), "left")
    return found.select(met["doc_id"], met["__key"], "n_hit", "items")


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_words = F.greatest(F.coalesce(F.size(words_of(F.col("text"))), F.lit(0)), F.lit(0)).cast("long")
    counted = docs.select("doc_id", F.xxhash64("text").alias("__key"), n_words.alias("n_words"))
    return _report(counted, hits(docs, items, span))


def decontaminated(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with all their columns."""
    found = hits(docs, items, span).select(F.col("doc_id").alias("__id"), F.col("__key").alias("__hit_key"))
    found = written(found, "winnowing-found")
    keyed = docs.withColumn("__text_key", F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(found["__id"]) & (keyed["__text_key"] == found["__hit_key"])
    return keyed.join(found, same, "left_anti").select(*docs.columns)




def _report(counted: DataFrame, found: DataFrame) -> DataFrame:
    found = found.withColumnsRenamed({"doc_id": "__id", "__key": "__hit_key"})
    joined = counted.join(found, counted["doc_id"].eqNullSafe(found["__id"]) & (counted["__key"] == found["__hit_key"]), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
