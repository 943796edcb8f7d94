"""Language-model scores from a log-frequency Bloom filter.

Counts of n-grams are quantised: a count c has level 1 + floor(log_b c), and the filter holds
the n-gram with each level from 1 up to its own. A worker finds a count by probing the
n-gram with level 1, 2, ... until a probe fails; chance errors only raise a count, and with
probability falling by level. The filter is cut into buckets by the n-gram's hash, each with its own
bits in proportion to its entries, so the filter as a whole grows with the corpus, and error rates stay as they are.

Neither the filter nor the texts are sent round. Rows are dealt to parts of about ``PART_BYTES`` by their content, and a
part sends each bucket its different n-grams once, with their counts in training rows. The task of a bucket builds the bucket's bits
from the counts of all parts, probes them for what each part has sent, and returns a level per n-gram in the part's
order. The part meets its answers and finishes the scores. Texts move once, n-grams once, levels once, whatever the
size of the corpus.

Probabilities are interpolated with a Dirichlet prior: with c(.) read from the filter,
p(w | h) = (c(h w) + m p'(w)) / (c(h) + m), where p' is the next shorter context; below words
lies p(w) = c(w) / (N + V), and V / (N + V) for words never seen (N tokens, V of them different).
c(h w) is held to at most c(h), which corrects some of the chance errors.

The base score needs exact counts. Words with at least N / ``FREQUENT`` tokens, which are at most
``FREQUENT`` words, are sent to the workers; the buckets add up the counts of the others, by whole hashes.

Cases: a null text is empty, and an empty text is its end token alone; rows without ``doc_id`` are
learnt from (they are in no held-out fold) and scored; repeated rows are learnt from and
returned as often as they come; without training rows base is log10(0.1/0.1) = 0 a token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framekiln.llm.common import Tokens, chunks, fold, mixed, texts_of
from framekiln.session import written

ORDER = 2
LEVEL_BASE = 1.5
BITS = 10
PROBES = 6
PRIOR = 300.0
TURN_BYTES = 48 << 20
BUCKET_TOKENS = 1 << 20
PART_BYTES = 8 << 20
FREQUENT = 1 << 20
END = int(mixed(np.array([0xE0D], np.uint64))[0])
START = int(mixed(np.array([0x57A], np.uint64))[0])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ngrams(texts: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the 1-, 2- ... ``order``-grams that end at each token, and the tokens of each text.

    Each text ends in the end token; contexts reach back to a start mark at most.
    """
    tokens = Tokens(texts)
    words = np.diff(tokens.first)
    counts = words + 1
    ends = np.cumsum(counts) - 1
    unigrams = np.full(int(counts.sum()), END, np.uint64)
    inside = np.ones(len(unigrams), bool)
    inside[ends] = False
    unigrams[inside] = tokens.hash
    out = [unigrams]
    for n in range(2, order + 1):
        out.append(mixed(_context(out[-1], counts) * _MIX + unigrams + np.uint64(n)))
    return out, counts


def _context(shorter: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The n-gram that ends before each token; at a text's begin the start mark."""
    context = np.empty_like(shorter)
    context[1:] = shorter[:-1]
    context[np.append(0, np.cumsum(counts)[:-1])] = START
    return context


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_counts=True)


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c): hash and count of every token of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for _, texts in chunks(batches):
            held.append(ngrams(texts, 1)[0][0])
            size += len(held[-1])
            if size >= 1 << 21:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    def batch(held: list[np.ndarray]) -> pa.RecordBatch:
        word, count = _counted(np.concatenate(held))
        return pa.record_batch({"word": pa.array(word.view(np.int64)), "c": pa.array(count)})

    return train.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _buckets(hashes: np.ndarray, count: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)).astype(np.int64) * count) >> 24


def _quantised(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(base) + 1e-9).astype(np.int64)


_LOW = np.uint64((1 << 40) - 1)


def _steps(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit numbers of a (hash, level) entry, from which all its places follow."""
    both = mixed((hashes & _LOW) + np.array([level], np.uint64) * _MIX)
    return both >> np.uint64(32), both & np.uint64(0xFFFFFFFF) | np.uint64(1)


def _place(first: np.ndarray, step: np.ndarray, bits: np.ndarray | int, probe: int) -> np.ndarray:
    """Bit of an entry for one probe, inside its bucket."""
    at = (first + step * np.array([probe], np.uint64)) & np.uint64(0xFFFFFFFF)
    return (at * np.asarray(bits, np.uint64) >> np.uint64(32)).astype(np.int64)


def _lowest(hashes: np.ndarray) -> np.ndarray:
    """The lower 40 bits of each hash, as five bytes."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _widened(lowest: list[bytes]) -> np.ndarray:
    low = np.frombuffer(b"".join(lowest), np.uint8).reshape(-1, 5)
    value = np.zeros((len(low), 8), np.uint8)
    value[:, :5] = low
    return value.view("<u8").ravel()


def _bits(value: np.ndarray, count: np.ndarray, base: float) -> tuple[int, bytes]:
    """Entries and bits of one bucket that holds the n-grams ``value`` with these counts."""
    level = _quantised(count, base)
    entries = int(level.sum())
    bits = max(64, -(-entries * BITS // 64) * 64)
    filled = np.zeros(bits, bool)
    for l in range(1, int(level.max(initial=0)) + 1):
        first, step = _steps(value[level >= l], l)
        for probe in range(PROBES):
            filled[_place(first, step, bits, probe)] = True
    return entries, np.packbits(filled).tobytes()


def bloom_filter(train: DataFrame, buckets: int, order: int = ORDER, base: float = LEVEL_BASE) -> DataFrame:
    """(bucket, entries, bits): the log-frequency filter of all n-grams of the training texts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for _, texts in chunks(batches):
            grams, counts = ngrams(texts, order)
            held += [*grams, np.full(len(counts), START, np.uint64)]
            size += sum(map(len, grams))
            if size >= 1 << 21:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        """Per bucket the lower 40 bits of its hashes, which tell them apart there, and counts up to 255, as bytes."""
        value, count = _counted(np.concatenate(held))
        times = -(-count // 255)  # larger counts come in several entries
        value, count = np.repeat(value, times), np.repeat(count, times)
        last = np.cumsum(times) - 1
        whole = np.ones(len(value), bool)
        whole[last] = False
        rest = count - 255 * (np.repeat(times, times) - 1)
        count = np.where(whole, 255, rest).astype(np.uint8)
        bucket = _buckets(value, buckets)  # rises with the hash
        low = _lowest(value)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        begin, end = np.append(0, cuts), np.append(cuts, len(bucket))
        return pa.record_batch(
            {
                "bucket": pa.array(bucket[begin]),
                "hashes": pa.array([low[a:b].tobytes() for a, b in zip(begin, end)], pa.binary()),
                "counts": pa.array([count[a:b].tobytes() for a, b in zip(begin, end)], pa.binary()),
            }
        )

    def build(key: tuple, parts: pa.Table) -> pa.Table:
        value, inverse = np.unique(_widened(parts.column("hashes").to_pylist()), return_inverse=True)
        count = np.frombuffer(b"".join(parts.column("counts").to_pylist()), np.uint8)
        entries, bits = _bits(value, np.bincount(inverse, weights=count), base)
        return pa.table(
            {
                "bucket": pa.array([key[0].as_py()], pa.int64()),
                "entries": pa.array([entries], pa.int64()),
                "bits": pa.array([bits], pa.binary()),
            }
        )

    parts = train.select("text").mapInArrow(emit, "bucket long, hashes binary, counts binary")
    return parts.groupBy("bucket").applyInArrow(build, "bucket long, entries long, bits binary")


class Turn:
    """Some buckets of the filter, and probes into them."""

    def __init__(self, buckets: int, rows) -> None:
        self.buckets = buckets
        self.bits = np.zeros(buckets, np.int64)
        self.at = np.zeros(buckets, np.int64)
        data = bytearray()
        for row in rows:
            self.bits[row["bucket"]], self.at[row["bucket"]] = 8 * len(row["bits"]), len(data)
            data += row["bits"]
        self.data = np.frombuffer(data, np.uint8)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Highest level of each n-gram in this turn's buckets; 0 where it is absent or elsewhere.

        Frequent n-grams have the most levels to probe, so each different one is probed once.
        """
        out = np.zeros(len(hashes), np.uint8)
        here = np.flatnonzero(self.bits[_buckets(hashes, self.buckets)] > 0)
        different, place = np.unique(hashes[here], return_inverse=True)
        out[here] = self._probed(different)[place]
        return out

    def _probed(self, hashes: np.ndarray) -> np.ndarray:
        bucket = _buckets(hashes, self.buckets)
        out = np.zeros(len(hashes), np.uint8)
        alive = np.flatnonzero(self.bits[bucket] > 0)
        level = 0
        while len(alive):
            level += 1
            first, step = _steps(hashes[alive], level)
            own = bucket[alive]
            bits, at = self.bits[own], self.at[own]
            for probe in range(PROBES):
                place = _place(first, step, bits, probe)
                hit = np.flatnonzero((self.data[at + (place >> 3)] >> (7 - (place & 7)).astype(np.uint8)) & 1)
                if len(hit) < len(alive):
                    alive, first, step, bits, at = alive[hit], first[hit], step[hit], bits[hit], at[hit]
            out[alive] = level
        return out


def _estimates(level: np.ndarray, base: float) -> np.ndarray:
    """Middle of the counts that share a level; 0 for level 0."""
    each = np.arange(int(level.max(initial=0)) + 1, dtype=float)
    low, high = np.ceil(base ** (each - 1) - 1e-9), np.maximum(np.ceil(base**each - 1e-9) - 1, 1)
    return np.where(each > 0, (low + np.maximum(high, low)) / 2, 0.0)[level]


def log_probabilities(levels: list[np.ndarray], contexts: list[np.ndarray], total: int, kinds: int, prior: float, base: float) -> np.ndarray:
    """log10 p of each token from the levels of its n-grams and of their contexts."""
    count = _estimates(levels[0], base)
    p = np.where(count > 0, count, max(kinds, 1)) / max(total + kinds, 1)
    for gram, context in zip(levels[1:], contexts):
        history = _estimates(context, base)
        p = (np.minimum(_estimates(gram, base), history) + prior * p) / (history + prior)
    return np.log10(np.minimum(p, 1.0))


def scored(docs: DataFrame, folds: int = 10, held_out: int = 0, order: int = ORDER, prior: float = PRIOR, base: float = LEVEL_BASE, turn_bytes: int = TURN_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    No task holds more than about ``turn_bytes`` of the filter.
    """
    spark = docs.sparkSession
    docs = texts_of(docs)
    out = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    train = docs.filter(~out)

    counts = written(word_counts(train), "lm-words")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = counts.filter(F.col("c") * FREQUENT >= total).toArrow()  # FREQUENT words at most
    known = spark.sparkContext.broadcast((frequent.column("word").to_numpy(), frequent.column("c").to_numpy()))

    # An n-gram has no more levels than tokens, so BITS bits for each token bound a bucket.
    buckets = max(1, -(-int(total) * order // min(BUCKET_TOKENS, max(1, 8 * turn_bytes // BITS))))
    size = docs.agg(F.sum(F.octet_length("text") + F.lit(32))).first()[0] or 0
    parts = max(1, -(-int(size) // PART_BYTES))

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", "text", out.alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).alias("part"))
    dealt = dealt.mapInArrow(_merged, f"part long, doc_id {kind}, text string, held_out boolean, copies long")
    asked = dealt.groupBy("part").applyInArrow(_asking(known, order, buckets), "bucket long, part long, hashes binary, counts binary, more binary, words binary, times binary")
    answers = asked.groupBy("bucket").applyInArrow(_answering(base), "part long, bucket long, levels binary, times binary")
    finished = _finishing(known, order, int(total), int(kinds), prior, base)
    schema = f"doc_id {kind}, held_out boolean, copies long, n_tokens long, n_known long, base_score double, score double"
    # Both sides read the same shuffled parts.
    rows = written(dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(finished, schema), "lm-scores")
    # Copies are those of one batch, so arrays stay short.
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch become one with their number, so that a row that recurs often does not fill its part."""
    names = ["part", "doc_id", "text", "held_out"]
    for batch in batches:
        merged = pa.Table.from_batches([batch]).group_by(names).aggregate([([], "count_all")])
        yield from merged.rename_columns({"count_all": "copies"}).select([*names, "copies"]).combine_chunks().to_batches()


def _part_grams(rows: pa.Table, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """As ``ngrams``, of all rows of a part."""
    each = [ngrams(texts, order) for _, texts in chunks(rows.to_batches())]
    return [np.concatenate(x) for x in zip(*(grams for grams, _ in each))], np.concatenate([counts for _, counts in each])


def _frequent(known) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that were sent, sorted, and their counts."""
    words, counts = known.value
    words = words.view(np.uint64) if len(words) else np.zeros(0, np.uint64)
    by_hash = np.argsort(words)
    return words[by_hash], counts[by_hash]


def _found(words: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``words`` are in the sorted ``among``, and where."""
    if not len(among):
        return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(among, words), len(among) - 1)
    return among[at] == words, at


def _asking(known, order: int, buckets: int):
    """A part's different n-grams, dealt to buckets: lower bits of the hashes, and counts in training rows.

    ``counts`` has a byte each; ``more`` has (place, count) of counts above 254. ``words`` are whole hashes of words that were not sent
    to the workers, ``times`` their counts.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        grams, counts = _part_grams(rows, order)
        taught = np.where(rows.column("held_out").to_numpy(), 0, rows.column("copies").to_numpy())
        weight = np.repeat(taught, counts)
        every = np.concatenate([*grams, np.full(len(counts), START, np.uint64)])
        value, inverse = np.unique(every, return_inverse=True)
        count = np.bincount(inverse, weights=np.concatenate([*[weight] * order, taught])).astype(np.int64)
        del every, inverse
        word, inverse = np.unique(grams[0], return_inverse=True)
        times = np.bincount(inverse, weights=weight).astype(np.int64)
        rare = ~_found(word, _frequent(known)[0])[0]
        word, times = word[rare], times[rare]
        bucket = _buckets(value, buckets)  # rises with the hash
        low, small = _lowest(value), np.minimum(count, 255).astype(np.uint8)
        asked = np.unique(bucket)
        cut = np.searchsorted(bucket, np.append(asked, buckets))
        word_cut = np.searchsorted(_buckets(word, buckets), np.append(asked, buckets))

        def more(a: int, b: int) -> bytes:
            large = np.flatnonzero(small[a:b] == 255)
            return np.column_stack([large, count[a:b][large]]).tobytes()

        spans, word_spans = list(zip(cut[:-1], cut[1:])), list(zip(word_cut[:-1], word_cut[1:]))
        return pa.table(
            {
                "bucket": pa.array(asked),
                "part": pa.array(np.full(len(asked), key[0].as_py(), np.int64)),
                "hashes": pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()),
                "counts": pa.array([small[a:b].tobytes() for a, b in spans], pa.binary()),
                "more": pa.array([more(a, b) for a, b in spans], pa.binary()),
                "words": pa.array([word[a:b].tobytes() for a, b in word_spans], pa.binary()),
                "times": pa.array([times[a:b].tobytes() for a, b in word_spans], pa.binary()),
            }
        )

    return run


def _summed(value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values, their summed counts, and the place of each entry among them."""
    different, place = np.unique(value, return_inverse=True)
    return different, np.bincount(place, weights=count, minlength=len(different)), place


def _answering(base: float):
    """For each part the levels of its n-grams in one bucket, and the exact counts of its words there."""

    def run(key: tuple, asked: pa.Table) -> pa.Table:
        hashes = asked.column("hashes").to_pylist()
        value = _widened(hashes)
        size = np.array([len(x) // 5 for x in hashes])
        begin = np.cumsum(size) - size
        count = np.frombuffer(b"".join(asked.column("counts").to_pylist()), np.uint8).astype(np.int64)
        for first, more in zip(begin, asked.column("more").to_pylist()):
            place, large = np.frombuffer(more, np.int64).reshape(-1, 2).T
            count[first + place] = large
        different, count, place = _summed(value, count)
        taught = count > 0
        turn = Turn(1, [{"bucket": 0, "bits": _bits(different[taught], count[taught], base)[1]}])
        levels = turn.levels(different)[place]
        word_size = [len(x) // 8 for x in asked.column("words").to_pylist()]
        words = np.frombuffer(b"".join(asked.column("words").to_pylist()), np.uint64)
        times = np.frombuffer(b"".join(asked.column("times").to_pylist()), np.int64)
        _, times, place = _summed(words, times)
        times = times.astype(np.int64)[place]
        word_end = np.cumsum(word_size)
        return pa.table(
            {
                "part": asked.column("part"),
                "bucket": asked.column("bucket"),
                "levels": pa.array([levels[a : a + n].tobytes() for a, n in zip(begin, size)], pa.binary()),
                "times": pa.array([times[b - n : b].tobytes() for b, n in zip(word_end, word_size)], pa.binary()),
            }
        )

    return run


def _finishing(known, order: int, total: int, kinds: int, prior: float, base: float):
    """Scores of a part's rows from the answers of all buckets, which come in the order of hashes."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        grams, counts = _part_grams(rows, order)
        answers = answers.sort_by("bucket")
        level = np.frombuffer(b"".join(answers.column("levels").to_pylist()), np.uint8)
        times = np.frombuffer(b"".join(answers.column("times").to_pylist()), np.int64)
        value, place = np.unique(np.concatenate([*grams, np.array([START], np.uint64)]), return_inverse=True)
        different, same = np.unique(grams[0], return_inverse=True)
        words, counts_of = _frequent(known)
        sent, at = _found(different, words)
        if len(level) != len(value) or len(times) != len(different) - sent.sum():
            raise RuntimeError("a part's answers do not fit its n-grams")
        heads = np.append(0, np.cumsum(counts)[:-1])
        tokens = len(grams[0])
        levels = [level[place[k * tokens : (k + 1) * tokens]] for k in range(order)]
        contexts = []
        for shorter in levels[: order - 1]:
            context = np.empty_like(shorter)
            context[1:] = shorter[:-1]
            context[heads] = level[place[-1]]
            contexts.append(context)
        score = np.add.reduceat(log_probabilities(levels, contexts, total, kinds, prior, base), heads)
        count = np.zeros(len(different), np.int64)
        count[sent] = counts_of[at[sent]]
        count[~sent] = times
        chance = np.log10((count + 0.1) / (total + 0.1 * (kinds + 1)))
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "held_out": rows.column("held_out"),
                "copies": rows.column("copies"),
                "n_tokens": pa.array(counts, pa.int64()),
                "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64)[same], heads)),
                "base_score": pa.array(np.add.reduceat(chance[same], heads)),
                "score": pa.array(score),
            }
        )

    return run
