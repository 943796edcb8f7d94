"""Python functions give outputs in pieces, so that a task never holds those of a whole batch."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framekiln.functions import captions, images, pieces
from framekiln.operators import features
from workload import media


def test_pieces_keep_order_and_bound_size():
    values = [np.zeros(1 << 20, np.uint8), *range(1000), np.zeros(40 << 20, np.uint8), "end"] * 5
    got = list(pieces.pieces(values))
    assert [id(v) for piece in got for v in piece] == [id(v) for v in values]
    assert all(sum(map(pieces.weight, piece[:-1])) < pieces.PIECE_BYTES for piece in got)
    assert len(got) == 6 and list(pieces.pieces([])) == []


def lengths(column, *inputs):
    """How many rows the pieces of one batch have, by the function inside a column's UDF."""
    found = []

    def seek(function):
        for cell in function.__closure__ or ():
            value = cell.cell_contents
            if hasattr(value, "evalType") and hasattr(value, "func"):
                found.append(value.func)
            elif callable(value) and hasattr(value, "__closure__"):
                seek(value)

    seek(column)
    batch = inputs if len(inputs) > 1 else inputs[0]
    return [len(piece) for piece in found[0](iter([batch]))]


def test_encoder_and_tagger_give_pieces(spark):
    words = pd.Series(["word " * 4000] * 100)
    encoded = lengths(features.encoder(media.word_lengths, "array<array<float>>", 3), words, pd.Series([0] * 100))
    assert sum(encoded) == 100 and len(encoded) > 5 and max(encoded) < 20
    tagged = lengths(captions.tag_tokens(lambda: lambda c: (c.split(), c.split(), [], [])), words)
    assert sum(tagged) == 100 and len(tagged) > 5


@pytest.mark.parametrize("rows", [0, 3, 25])
def test_rows_stay_with_their_outputs(spark, rows):
    """Several pieces of a batch line up with its rows, also where an image is broken."""
    png = media.png_bytes(np.full((600, 700, 3), 7, np.uint8))
    df = spark.createDataFrame([(i, b"junk" if i % 5 == 4 else png, "a " * (i % 7 + 1) * 9000) for i in range(rows)], "i int, png binary, txt string")
    pixels = images.decode_image(F.col("png"), lambda: images.png_pixels)
    made = images.transform_image(F.col("png"), F.lit(600), F.lit(700), lambda: images.png_pixels)
    words = features.encoder(media.word_lengths, "array<array<float>>", 4)
    got = df.coalesce(1).select("i", F.size(pixels["pixels"]).alias("p"), F.size(made["pixels"]).alias("m"), F.size(words(F.col("txt"))).alias("w")).collect()
    want = [(i, None if i % 5 == 4 else 1260000, None if i % 5 == 4 else 1260000, 9000 * (i % 7 + 1) + 1) for i in range(rows)]
    assert [(r.i, *(None if v in (None, -1) else v for v in (r.p, r.m)), r.w) for r in got] == want
