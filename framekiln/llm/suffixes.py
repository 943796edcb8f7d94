"""Repeated passages by a sparse suffix array.

Suffixes start only where content says so: the k-gram of words (k = ``GRAM``) with the smallest
hash of each run of ``min_words`` - k + 1 neighbouring k-grams. Equal passages of ``min_words`` words have
such a place in common. Suffixes whose k-gram occurs once can't belong to a repeat and are dropped by
a count of hashes. The others are sorted over the cluster by k-gram, the words that follow and
then the words before it (read backwards); a range partitioning splits even a k-gram that a
third of all documents share.

A window of ``min_words`` words around a k-gram takes r words after it and the others before it. The words
that neighbours share to the right number the suffixes that agree in their next r words, and
those that neighbours in the order of the words before share number the suffixes that agree there; a window recurs if
a pair of such numbers comes twice. So every r is decided by neighbours alone, for
k-grams of any frequency. K-grams at the first or last place of a partition may go on in another
one; their words on each side are sorted over the cluster and cut to those that a neighbour shares, as
no window that recurs reaches further. What is left is the same for all texts that share a passage, so its windows are
hashed once for each such context, and counted over all partitions. The windows that recur extend
a suffix to the left and right, and the parts of a document are joined, so every passage of ``min_words`` or more is
returned, and returned whole.

Cases: null and empty texts and texts below ``min_words`` have no passages; rows that repeat, also
under one ``doc_id``, are copies of each other; a null ``doc_id`` is returned as null and is never
preferred as ``first_doc``; a passage that occurs twice in one document is a repeat as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framekiln.llm.common import Tokens, chunks, mixed, texts_of
from framekiln.session import written

GRAM = 32
MIN_WORDS = 50
# Rows that are compared at a time; a k-gram with more of them is compared as a whole if it ends in its partition.
ROWS = 20_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def sampled(texts: list[bytes], gram: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word position, hash) of the smallest k-gram of each run of ``run`` neighbouring k-grams."""
    tokens = Tokens(texts)
    count = len(tokens.hash)
    grams = count - gram + 1
    if grams < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power = _powers(_BASE, count)
    total = np.append(np.uint64(0), np.cumsum(tokens.hash * power[:count], dtype=np.uint64))
    code = mixed((total[gram:] - total[:grams]) * _powers(_INVERSE, grams)[:grams])
    windows = np.lib.stride_tricks.sliding_window_view(code, run)
    whole = np.flatnonzero(tokens.doc[: len(windows)] == tokens.doc[gram + run - 2 :])
    place = np.unique(windows[whole].argmin(axis=1) + whole)
    doc = tokens.doc[place]
    return doc, place - tokens.first[doc], code[place]


def _common(a: list[str], b: list[str]) -> int:
    """Words that two lists share from the begin on."""
    if a == b:
        return len(a)
    shared = 0
    for x, y in zip(a, b):
        if x != y:
            break
        shared += 1
    return shared


def _agreement(code: list[int], words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by k-gram and words, and how many words each shares with the one before it (-1: another k-gram)."""
    order = sorted(range(len(code)), key=lambda i: (code[i], words[i]))
    shared = [-1] * len(code)
    for k in range(1, len(code)):
        i, j = order[k - 1], order[k]
        if code[i] == code[j]:
            shared[k] = _common(words[i], words[j])
    return np.array(order, np.int64), np.array(shared, np.int64)


def recurring(code: list[int], left: list[list[str]], right: list[list[str]], reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fewest, most, partner): words to the right in the windows of each suffix that recur, and a suffix with such a window.

    A window takes r words to the right and ``reach`` - r to the left; without any, all three are -1.
    """
    count = len(code)
    fewest, most, partner = (np.full(count, -1, np.int64) for _ in range(3))
    by_right, shared_right = _agreement(code, right)
    by_left, shared_left = _agreement(code, left)
    n_left, n_right = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    same_right, same_left = np.empty(count, np.int64), np.empty(count, np.int64)
    for r in range(reach + 1):
        same_right[by_right] = np.cumsum(shared_right < r)
        same_left[by_left] = np.cumsum(shared_left < reach - r)
        whole = np.flatnonzero((n_right >= r) & (n_left >= reach - r))
        window = same_right[whole] * (count + 1) + same_left[whole]
        order = np.argsort(window, kind="stable")
        window, place = window[order], whole[order]
        head = np.flatnonzero(np.append(True, window[1:] != window[:-1])) if len(window) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(window)))
        again = np.repeat(size > 1, size)
        first = np.repeat(head, size)
        other = place[np.where(np.arange(len(window)) == first, np.minimum(first + 1, len(window) - 1), first)][again]
        place = place[again]
        fresh = fewest[place] < 0
        fewest[place[fresh]], partner[place[fresh]] = r, other[fresh]
        most[place] = r
    return fewest, most, partner


def _split(texts: list[str]) -> list[list[str]]:
    return [x.split(" ") if x else [] for x in texts]


def _shared(code: list[int], words: list[list[str]]) -> list[int]:
    """Words that each suffix shares with a neighbour of its k-gram; the first and last may go on elsewhere and keep all."""
    count = len(code)
    agree = [_common(words[i - 1], words[i]) if code[i - 1] == code[i] else 0 for i in range(1, count)]
    inner = [max(agree[i - 1], agree[i]) for i in range(1, count - 1)]
    return [len(words[0]), *inner, len(words[-1])][:count] if count else []


def _windows(left: list[str], right: list[str], reach: int) -> list[int | None]:
    """A 64-bit hash of each window around a k-gram, by its words to the right; null where the text ends before."""
    out: list[int | None] = []
    for r in range(reach + 1):
        if len(right) < r or len(left) < reach - r:
            out.append(None)
        else:
            out.append(xxhash.xxh64_intdigest("\t".join([*left[: reach - r][::-1], *right[:r]]).encode("utf-8", "replace")) - (1 << 63))
    return out


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, end, n_words, match_doc, first_doc): every repeated passage of every document.

    Places count words (runs without ASCII white space, A-Z lowered); ``match_doc`` is a document in which the passage or a part of it
    recurs, ``first_doc`` the smallest one known for it.
    """
    spark = docs.sparkSession
    run = min_words - gram + 1
    docs = texts_of(docs).withColumn("key", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            doc, at, code = sampled(texts, gram, run)
            picked = pa.array(doc, pa.int64())
            yield pa.record_batch(
                {
                    "doc_id": rows.column("doc_id").take(picked),
                    "key": rows.column("key").take(picked),
                    "at": pa.array(at, pa.int32()),
                    "hash": pa.array(code.view(np.int64)),
                }
            )

    places = written(docs.mapInArrow(sample, f"doc_id {kind}, key long, at int, hash long"), "suffixes-places")
    counted = places.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    again = written(counted.filter("n > 1").select("hash", "first_doc"), "suffixes-again")
    kept = places.join(again, "hash", "left_semi")
    by_doc = kept.groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "hash")).alias("places"))
    by_doc = written(by_doc, "suffixes-kept").withColumnsRenamed({"doc_id": "__id", "key": "__key"})
    near = docs.join(by_doc, docs["doc_id"].eqNullSafe(by_doc["__id"]) & (docs["key"] == by_doc["__key"])).select("doc_id", "key", "text", "places")

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = run - 1
        for rows, texts in chunks(batches):
            index, at, code, left, right = [], [], [], [], []
            for i, (text, own) in enumerate(zip(texts, rows.column("places").to_pylist())):
                words = text.lower().split()
                for place in own:
                    p = place["at"]
                    index.append(i)
                    at.append(p)
                    code.append(place["hash"])
                    left.append(b" ".join(words[max(0, p - reach) : p][::-1]))
                    right.append(b" ".join(words[p + gram : p + gram + reach]))
            picked = pa.array(index, pa.int64())
            yield pa.record_batch(
                {
                    "hash": pa.array(code, pa.int64()),
                    "right": pa.array(right, pa.binary()).cast(pa.string(), safe=False),
                    "left": pa.array(left, pa.binary()).cast(pa.string(), safe=False),
                    "doc_id": rows.column("doc_id").take(picked),
                    "key": rows.column("key").take(picked),
                    "at": pa.array(at, pa.int32()),
                }
            )

    suffixes = near.mapInArrow(context, f"hash long, right string, left string, doc_id {kind}, key long, at int")
    order = ["hash", "right", "left", "doc_id", "key", "at"]
    ordered = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)

    reach = run - 1
    parts_schema = f"doc_id {kind}, key long, at int, hash long, start int, end int, match_doc {kind}, left string, right string"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, last = None, [], None
        for rows in batches:
            if not rows.num_rows:
                continue
            code = rows.column("hash").to_numpy()
            first = int(code[0]) if first is None else first
            begin = 0
            if not held:
                begin = int((code == first).argmin()) if code[-1] != first else len(code)
                yield from edge(rows.slice(0, begin))
            if begin == len(code):
                continue
            goes_on = int(code[-1]) == last
            held.append(rows.slice(begin))
            last = int(code[-1])
            if not goes_on and sum(x.num_rows for x in held) >= ROWS:
                whole, rest = cut(held, last)
                yield from inside(whole)
                held = [rest]
        if held:
            whole, rest = cut(held, last)
            yield from inside(whole)
            yield from edge(rest)

    def cut(held: list[pa.RecordBatch], last: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """Rows before those of the last k-gram, and these."""
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        at = pc.index(rows.column("hash"), last).as_py()
        return rows.slice(0, at), rows.slice(at)

    def inside(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Parts of passages at k-grams whose rows are all here."""
        if rows.num_rows:
            left, right = (_split(rows.column(c).to_pylist()) for c in ("left", "right"))
            fewest, most, partner = recurring(rows.column("hash").to_pylist(), left, right, reach)
            found = np.flatnonzero(fewest >= 0)
            own, at = rows.take(pa.array(found)), rows.column("at").to_numpy()[found]
            yield pa.record_batch(
                {
                    **{c: own.column(c) for c in ("doc_id", "key", "at", "hash")},
                    "start": pa.array(at - reach + fewest[found], pa.int32()),
                    "end": pa.array(at + gram + most[found], pa.int32()),
                    "match_doc": rows.column("doc_id").take(pa.array(partner[found])),
                    **{c: pa.nulls(len(found), pa.string()) for c in ("left", "right")},
                }
            )

    def edge(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Rows of k-grams that may go on in another partition, with the words around them."""
        if rows.num_rows:
            yield pa.record_batch(
                {
                    **{c: rows.column(c) for c in ("doc_id", "key", "at", "hash")},
                    **{c: pa.nulls(rows.num_rows, pa.int32()) for c in ("start", "end")},
                    "match_doc": pa.nulls(rows.num_rows, rows.schema.field("doc_id").type),
                    **{c: rows.column(c) for c in ("left", "right")},
                }
            )

    def trimmed(rows: DataFrame, side: str, then: Callable | None = None) -> DataFrame:
        """The words on one side cut to those that another suffix of the k-gram shares; ``then`` makes the last column of each batch."""
        # Sorted as words, so that neighbours share most whatever bytes the words hold.
        place = ["hash", F.split(side, " "), "doc_id", "key", "at"]
        columns = ["doc_id", "key", "at", "hash", "left", "right"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            first = True
            for batch in batches:
                held = [x for x in (*held, batch) if x.num_rows]
                if sum(x.num_rows for x in held) > ROWS:
                    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    yield cut_to(rows, 0 if first else 1, rows.num_rows - 1)
                    held, first = [rows.slice(rows.num_rows - 2)], False
            if held:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield cut_to(rows, 0 if first else 1, rows.num_rows)

        def cut_to(rows: pa.RecordBatch, begin: int, end: int) -> pa.RecordBatch:
            words = _split(rows.column(side).to_pylist())
            most = _shared(rows.column("hash").to_pylist(), words)
            own = pa.array([" ".join(words[i][: most[i]]) for i in range(begin, end)], pa.string())
            rows = rows.slice(begin, end - begin)
            out = {c: own if c == side else rows.column(c) for c in columns}
            if then is None:
                return pa.record_batch(out)
            left, right = (_split(out.pop(c).to_pylist()) for c in ("left", "right"))
            return pa.record_batch({**out, "windows": then(left, right)})

        fields = f"doc_id {kind}, key long, at int, hash long, " + ("left string, right string" if then is None else "windows array<long>")
        return rows.select(*columns).repartitionByRange(*place).sortWithinPartitions(*place).mapInArrow(run, fields)

    def hashed(left: list[list[str]], right: list[list[str]]) -> pa.Array:
        return pa.array([_windows(x, y, reach) for x, y in zip(left, right)], pa.list_(pa.int64()))

    found = written(ordered.mapInArrow(compare, parts_schema), "suffixes-found")
    names = ["doc_id", "key", "start", "end", "match_doc", "hash"]
    crossing = written(trimmed(found.filter("left IS NOT NULL"), "right"), "suffixes-crossing")
    # A null would be left out of the hash, and the place of a window with it.
    around = F.xxhash64(F.transform("windows", lambda w: F.coalesce(w, F.lit(0))))
    open_ = written(trimmed(crossing, "left", hashed).withColumn("around", around), "suffixes-open")
    # Rows with the same words around a k-gram, as copies have, are one row from here on.
    alike = open_.groupBy("hash", "around").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("windows").alias("windows")
    )
    alike = written(alike, "suffixes-alike").select("hash", "around", "n", "low", "high", F.posexplode("windows").alias("r", "window")).filter("window IS NOT NULL")
    # The same words before one k-gram and after another are different windows.
    counted = alike.groupBy("hash", "r", "window").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    counted = written(counted.filter("n > 1").drop("n"), "suffixes-windows")
    marked = alike.drop("n", "low", "high").join(counted, ["hash", "r", "window"]).groupBy("hash", "around").agg(
        F.min("r").alias("fewest"), F.max("r").alias("most"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    shared = open_.join(written(marked, "suffixes-marked"), ["hash", "around"])
    shared = shared.select(
        "doc_id",
        "key",
        (F.col("at") - reach + F.col("fewest")).cast("int").alias("start"),
        (F.col("at") + gram + F.col("most")).cast("int").alias("end"),
        F.when(F.col("low").eqNullSafe(F.col("doc_id")), F.col("high")).otherwise(F.col("low")).alias("match_doc"),
        "hash",
    )
    parts = found.filter("left IS NULL").select(*names).union(shared)
    parts = parts.join(again, "hash").groupBy("doc_id", "key").agg(
        F.collect_set(F.struct("start", "end", "match_doc", "first_doc")).alias("parts")
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = lambda a, b: b if a is None else a if b is None else min(a, b)
        for rows in batches:
            index, out = [], []
            for i, own in enumerate(rows.column("parts").to_pylist()):
                spans: list[list] = []
                for x in sorted(own, key=lambda x: (x["start"], x["end"])):
                    if spans and x["start"] <= spans[-1][1]:
                        last = spans[-1]
                        spans[-1] = [last[0], max(last[1], x["end"]), least(last[2], x["match_doc"]), least(last[3], x["first_doc"])]
                    else:
                        spans.append([x["start"], x["end"], x["match_doc"], x["first_doc"]])
                index += [i] * len(spans)
                out += spans
            kind_ = rows.schema.field("doc_id").type
            yield pa.record_batch(
                {
                    "doc_id": rows.column("doc_id").take(pa.array(index, pa.int64())),
                    "start": pa.array([s[0] for s in out], pa.int64()),
                    "end": pa.array([s[1] for s in out], pa.int64()),
                    "n_words": pa.array([s[1] - s[0] for s in out], pa.int64()),
                    "match_doc": pa.array([s[2] for s in out], kind_),
                    "first_doc": pa.array([s[3] for s in out], kind_),
                }
            )

    return parts.mapInArrow(merge, f"doc_id {kind}, start long, end long, n_words long, match_doc {kind}, first_doc {kind}")
