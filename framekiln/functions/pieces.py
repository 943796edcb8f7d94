"""Outputs of Python functions in pieces of bounded size.

A batch that comes from Spark may hold 10,000 rows. Where a row gets much larger in Python (tokens, pixels, embeddings), the
outputs leave in pieces, so a task holds one piece and not the outputs of a whole batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

# What a piece may hold by estimate, unless one row alone has more.
PIECE_BYTES = 8 << 20
OBJECT_BYTES = 64


def weight(value) -> int:
    """About how many bytes a value takes in Python; a sequence counts as so many of its first item."""
    if hasattr(value, "nbytes"):
        return int(value.nbytes) + OBJECT_BYTES
    if isinstance(value, (str, bytes)):
        return len(value) + OBJECT_BYTES
    if isinstance(value, tuple):  # a row: its fields differ
        return sum(map(weight, value)) + OBJECT_BYTES
    if isinstance(value, list) and value:
        return len(value) * weight(value[0]) + OBJECT_BYTES
    return OBJECT_BYTES


def pieces(values: Iterable) -> Iterator[list]:
    """The values in order, as lists of about ``PIECE_BYTES``."""
    held, size = [], 0
    for value in values:
        held.append(value)
        size += weight(value)
        if size >= PIECE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held
