"""Packing token pieces into sequences by shortest-pack-first over the length histogram.

1. Tasks tokenise whole texts and cut each document's ids (its tokens and one end id) into
   pieces of ``size`` ids and a rest; only the narrow rows of pieces go on.
2. The histogram of piece lengths, at most ``size`` numbers, is packed on the driver: lengths
   are placed longest first, each on the shortest packs that it still fits, and new packs open
   only when none fits. Packs of equal content are one pattern with a count, so the
   work follows the number of patterns and not of documents; there are at most two patterns per
   length, and a pattern has at most 44 different lengths, which bounds the table.
3. Patterns are joined back by rank: pieces of one length are numbered without a window over
   the length (a third of all pieces may share one), and each run of ranks belongs to one
   pattern's slot.

Tokens come from the rank form of the byte-level vocabulary, which gives the same ids
as the ``tokenizers`` form. Texts are cut at the strings of that form's added tokens first, which have ids of their own. Text is cut
before single blanks between visible characters, where no token of this vocabulary's
splitting pattern crosses, and ids of such a word are looked up in a bounded memory of words.

Cases: a null or empty text is the end id alone; repeated rows are packed once for each row;
equal lengths are ranked by a hash of ``doc_id``, then ``doc_id`` and place, and rows that tie in
all of these are alike, so any order of them is the same packing.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framekiln.llm.common import chunks, texts_of
from framekiln.operators.numbering import with_ordinal
from framekiln.session import written

SIZE = 1024
KNOWN_WORDS = 200_000
BLOCK_PIECES = 65536


class WordIds:
    """Token ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def _fresh(self, word: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(word), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        head, *words = text.split(" ")
        # A cut before a blank is safe only between two visible characters.
        if not words or not head or "" in words or re.search(r"\s\s|\s$", text):
            return b"".join(self._part(part) for part in re.split(r"(?<=\S)(?= \S)", text))
        known, out = self.known, [self._fresh(head)]
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = self._learn(word)
            out.append(ids)
        return b"".join(out)

    def _learn(self, word: str) -> bytes:
        ids = self._fresh(" " + word)
        if len(word) <= 64:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        if part[:1] == " ":
            return self.known.get(part[1:]) or self._learn(part[1:])
        return self._fresh(part)


def added_tokens() -> dict[str, int]:
    """Strings and ids of the added tokens of the public byte-level vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}


def ids_with_added(ids_of: Callable[[str], bytes], added: dict[str, int]) -> Callable[[str], bytes]:
    """``ids_of`` for what lies between added tokens, and the ids of these; the longest of those that begin at one place counts."""
    if not added:
        return ids_of
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    own = {token: np.array([id_], "<u4").tobytes() for token, id_ in added.items()}

    def run(text: str) -> bytes:
        parts = cut.split(text)
        if len(parts) == 1:
            return ids_of(text)
        return b"".join(own[part] if i % 2 else ids_of(part) for i, part in enumerate(parts))

    return run


def pieces(
    docs: DataFrame, ranks_path: str, pattern: str, size: int = SIZE, end_id: int = 0, added: dict[str, int] | None = None
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids in pieces.

    ``added`` has the added tokens; without it they are those of the public vocabulary.
    """
    added = added_tokens() if added is None else added
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = ids_with_added(WordIds(ranks_path, pattern), added)
        for rows, texts in chunks(batches):
            index, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(texts):
                ids = ids_of(text.decode("utf-8", "replace")) + last
                count = len(ids) // 4
                for at in range(0, count, size):
                    index.append(i)
                    start.append(at)
                    length.append(min(size, count - at))
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    total.append(count)
            yield pa.record_batch(
                {
                    "doc_id": rows.column("doc_id").take(pa.array(index, pa.int64())),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "doc_tokens": pa.array(total, pa.int64()),
                }
            )

    picked = texts_of(docs)
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """(count, {length: repeats}) per pattern, from the number of pieces of each length."""
    packs: dict[int, list[tuple[int, dict[int, int]]]] = {}
    for length in sorted(histogram, reverse=True):
        left, used = histogram[length], 0
        while left and used <= size - length:
            if not packs.get(used):
                used += 1
                continue
            count, pattern = packs[used].pop()
            here = min(count, left)
            if here < count:
                packs[used].append((count - here, pattern))
            grown = {**pattern, length: pattern.get(length, 0) + 1}
            packs.setdefault(used + length, []).append((here, grown))
            left -= here
        each = size // length
        for count, repeats in ((left // each, each), (1, left % each)):
            if count and repeats:
                packs.setdefault(length * repeats, []).append((count, {length: repeats}))
    return [pack for used in sorted(packs) for pack in packs[used]]


def _slots(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """(length, first rank, repeats, first sequence, offset) of each slot, by length and rank."""
    rows, ranks, sequence = [], {}, 0
    for count, pattern in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            rank = ranks.get(length, 0)
            rows.append((length, rank, pattern[length], sequence, offset))
            ranks[length] = rank + count * pattern[length]
            offset += length * pattern[length]
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``size`` ids."""
    cut = written(cut, "packing-pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``size`` rows
    slots = _slots(shortest_pack_first(histogram, size))
    blocks = max(1, -(-sum(histogram.values()) // BLOCK_PIECES))
    spread = cut.withColumn("__spread", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    ranked = with_ordinal(spread, ["__spread", "doc_id", "start"], ["length"], "__rank", blocks=[F.col("__spread")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = 1 << 44
        key = slots[:, 0] * span + slots[:, 1]
        for rows in batches:
            length, rank = rows.column("length").to_numpy(), rows.column("__rank").to_numpy()
            slot = slots[np.searchsorted(key, length * span + rank, side="right") - 1] if len(length) else slots[:0]
            at = rank - slot[:, 1]
            sequence, offset = slot[:, 3] + at // np.maximum(slot[:, 2], 1), slot[:, 4] + at % np.maximum(slot[:, 2], 1) * length
            kept = {c: rows.column(c) for c in names}
            yield pa.record_batch({**kept, "sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    names = cut.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.select(*names, "__rank").mapInArrow(place, f"{fields}, sequence_id long, offset long")


def tokenizer_files() -> tuple[str, str]:
    """The rank file of the public byte-level vocabulary and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pack_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, size: int = SIZE) -> DataFrame:
    """Pieces of all documents with their sequences."""
    if ranks_path is None:
        ranks_path, pattern = tokenizer_files()
    return packed(pieces(docs, ranks_path, pattern, size), size)
