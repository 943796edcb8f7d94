"""Reading, token arrays, folds, calibration and connected components, shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framekiln.session import written

CHUNK_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
# Bits of a filter that is sent to the workers: 8 MB at most.
FILTER_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Arrow batches are bounded by bytes, as texts may be long."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the whole ``text``; null texts become empty."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def send(spark: SparkSession, value) -> Broadcast:
    """Broadcast an object of this package's classes, to be read by ``received``; workers need no copy of the package.

    The caller has to know a bound of its size.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast):
    return cloudpickle.loads(sent.value)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null keys give null."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text without decoding; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches with at most ``CHUNK_BYTES`` of text each, one row at least."""
    for batch in batches:
        texts = byte_texts(batch.column(text))
        begin, held = 0, 0
        for i, value in enumerate(texts):
            if held and held + len(value) > CHUNK_BYTES:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, held = i, 0
            held += len(value)
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (the finaliser of MurmurHash3)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, (32, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# Everything in ASCII but digits and letters; bytes of other characters belong to words.
MARKS = np.arange(256) < 128
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Tokens:
    """Words (runs without ASCII white space, or without ``separators``; A-Z lowered) of texts, as arrays.

    ``hash`` has a 64-bit hash per word, ``doc`` the index of its text, ``start`` and
    ``end`` its place in ``data``; ``first`` has the first word of each text, and one more entry.
    """

    def __init__(self, texts: list[bytes], separators: np.ndarray = _SPACE) -> None:
        self.data = b"\n".join(texts).lower() + b"\n"
        data = np.frombuffer(self.data, np.uint8)
        begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
        word = ~separators[data]
        edge = np.diff(word.astype(np.int8), prepend=0)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, begins)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        if not len(self.start):
            self.hash = self._value = np.zeros(0, np.uint64)
            return
        length = self.end - self.start
        origin = np.zeros(len(data), np.int64)
        origin[self.start] = self.start
        at = np.arange(len(data)) - np.maximum.accumulate(origin)
        value = _TABLE[at & 31, data]
        value[~word] = 0
        if length.max() > 32:
            block = at >> 5
            far = (block > 0) & word
            value[far] *= mixed(block[far].astype(np.uint64) * _STEP) | np.uint64(1)
        self._value = value
        self.hash = mixed(np.add.reduceat(value, self.start) + length.astype(np.uint64) * _STEP)

    def beginnings(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of the first ``size`` bytes of each word that is longer."""
        longer = np.flatnonzero(self.end - self.start > size)
        if not len(longer):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        start = self.start[longer]
        value = self._value[start].copy()
        for i in range(1, size):
            value += self._value[start + i]
        return self.doc[longer], mixed(value + np.array([size], np.uint64) * _STEP + np.uint64(1))


def isotonic(score: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing steps through (score, label): pool adjacent violators.

    Returns the mean score of each step and its level, to be read by ``np.interp``.
    """
    weight = np.ones(len(score)) if weight is None else weight
    order = np.argsort(score, kind="stable")
    steps: list[list[float]] = []
    for s, y, w in zip(score[order], label[order], weight[order]):
        steps.append([w, w * y, w * s])
        while len(steps) > 1 and steps[-2][1] * steps[-1][0] >= steps[-1][1] * steps[-2][0]:
            last = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], last)]
    done = np.array(steps, float).reshape(-1, 3)
    return done[:, 2] / done[:, 0], done[:, 1] / done[:, 0]


class KeyFilter:
    """Whether a 64-bit key may be among given ones: never wrong for those, and of bounded size.

    Rows that it rules out need no join, so their texts are not shuffled. Beyond
    ``FILTER_BITS`` / 16 keys it lets more others pass; an exact join has to follow in any case.
    """

    def __init__(self, keys: DataFrame, bits: int = FILTER_BITS) -> None:
        """``keys`` has one column of longs; words of 64 bits are put together before they are collected."""
        (name,) = keys.columns
        count = keys.count()
        self.bits = min(bits, 1 << max(10, (16 * count).bit_length()))
        places = F.array(*[F.shiftrightunsigned(F.xxhash64(F.lit(probe), F.col(name)), 64 - self.bits.bit_length() + 1) for probe in (0, 1)])
        place = keys.select(F.explode(places).alias("place"))
        words = place.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("set"))
        held = words.toArrow()  # bits / 64 rows at most
        self.words = np.zeros(self.bits // 64, np.uint64)
        self.words[held.column("word").to_numpy()] = held.column("set").to_numpy().view(np.uint64)

    def split(self, rows: DataFrame, key: str, may: bool) -> DataFrame:
        """The rows whose key may be among the given ones, or those whose key is not."""
        shift = 64 - self.bits.bit_length() + 1
        shared = rows.sparkSession.sparkContext.broadcast(self.words)
        probed = rows.withColumns({f"__place{i}": F.shiftrightunsigned(F.xxhash64(F.lit(i), F.col(key)), shift) for i in (0, 1)})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = shared.value
            for batch in batches:
                hit = np.ones(batch.num_rows, bool)
                for i in (0, 1):
                    place = batch.column(f"__place{i}").to_numpy()
                    hit &= (words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
                yield batch.select(names).filter(pa.array(hit == may))

        names = rows.columns
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return probed.mapInArrow(run, fields)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node reachable.

    Alternating large-star and small-star steps; each halves paths, and a node's links
    are only ever reduced to a minimum with partial aggregation, so hubs do not meet in
    one task. Every round is a written table, which a lost executor reads again.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    pairs = written(pairs, label)
    seen = None
    while True:
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = written(large, label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        pairs = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), label)
