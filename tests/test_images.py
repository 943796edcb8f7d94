import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framekiln.functions import images
from workload.media import png_bytes


def filtered_png(pixels, kinds):
    """An RGB PNG whose rows use the given filter kinds."""
    height, width, _ = pixels.shape
    x = np.zeros((height + 1, width + 1, 3), int)
    x[1:, 1:] = pixels
    body = b""
    for y in range(1, height + 1):
        here, left, up, corner = x[y, 1:], x[y, :-1], x[y - 1, 1:], x[y - 1, :-1]
        near = left + up - corner
        a, b, c = abs(near - left), abs(near - up), abs(near - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = [0 * left, left, up, (left + up) // 2, paeth][kinds[(y - 1) % len(kinds)]]
        body += bytes([kinds[(y - 1) % len(kinds)]]) + ((here - guess) & 255).astype(np.uint8).tobytes()

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc4\x00\x03z\xff\xc0\x00\x0b\x08\x00\x21\x00\x2c\x03\x01\x11\x00"


def test_header_sizes():
    assert images.header_size(png_bytes(np.zeros((3, 5, 3), np.uint8))) == (3, 5)
    assert images.header_size(JPEG) == (33, 44)
    assert images.header_size(b"GIF89a") is None
    assert images.header_size(JPEG[:8]) is None


@pytest.mark.parametrize("kinds", [[0], [1], [2], [3], [4], [4, 1, 3, 2, 0]])
def test_png_filters(kinds):
    pixels = np.random.default_rng(1).integers(0, 256, (7, 6, 3)).astype(np.uint8)
    assert (images.png_pixels(filtered_png(pixels, kinds)) == pixels).all()


def test_resize_goldens():
    flat = np.full((4, 6, 3), 77, np.uint8)
    assert (images.resize_bilinear(flat, 9, 2) == 77).all()
    two = np.array([[0, 100], [100, 200]], np.uint8)[:, :, None].repeat(3, 2)
    # Growing by two: weights 1/4 and 3/4 between pixel centres.
    row = images.resize_bilinear(two, 2, 4)[0, :, 0]
    assert row.tolist() == [0, 25, 75, 100]
    # Shrinking to one pixel uses all of them.
    assert images.resize_bilinear(two, 1, 1).ravel().tolist() == [100, 100, 100]


def test_model_input_range():
    x = images.model_input(np.array([[[0, 255, 51]]], np.uint8), 2, 3)
    assert x.shape == (3, 2, 3)
    assert np.allclose(x[:, 0, 0], [-1.0, 1.0, -0.6])


def test_bicubic_keeps_constants_and_lines():
    flat = np.full((3, 5, 7), 0.25)
    assert np.allclose(images.resize_bicubic(flat, 12, 9), 0.25)
    line = np.tile(np.arange(16.0), (1, 4, 1))
    grown = images.resize_bicubic(line, 4, 32)[0, 0]
    # Away from the edges the kernel is symmetric around the line's own values.
    assert np.allclose(grown[8:24] + grown[23:7:-1], grown[8] + grown[23])


def test_vision_input():
    x = images.vision_input(np.zeros((3, 8, 8), np.float32))
    assert x.shape == (3, 224, 224)
    assert np.allclose(x[:, 5, 5], (0.5 - np.array(images.VISION_MEAN)) / np.array(images.VISION_STD), atol=1e-5)


def test_bad_images_are_reported(spark):
    good = png_bytes(np.full((2, 2, 3), 9, np.uint8))
    df = spark.createDataFrame([(0, bytearray(good)), (1, bytearray(b"junk")), (2, None)], "id int, image binary")
    got = df.select("id", images.decode_image(F.col("image")).alias("d"), images.image_size("image").alias("s")).orderBy("id").collect()
    assert got[0].d.pixels == [9.0] * 12 and got[0].d._error is None and tuple(got[0].s) == (2, 2)
    assert got[1].d.pixels is None and got[1].d._error and got[1].s.height is None
    assert got[2].d.pixels is None and got[2].d._error


def test_image_source_rows(spark, tmp_path):
    pixels = np.arange(24).reshape(2, 4, 3).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png_bytes(pixels))
    rows = spark.read.format("image").load(str(tmp_path))
    got = rows.select(images.from_image_source(F.col("image")).alias("x")).first().x
    assert got == pixels.ravel().tolist()


@pytest.mark.parametrize("size, target", [(7, 3), (3, 7), (9, 4), (4, 4), (5, 1)])
def test_bilinear_equals_the_formula(size, target):
    line = np.random.default_rng(size).integers(0, 256, size).astype(float)
    step = size / target
    reach = max(step, 1.0)
    want = []
    for i in range(target):
        weights = [max(0.0, 1 - abs(x + 0.5 - (i + 0.5) * step) / reach) for x in range(size)]
        want.append(np.floor(np.dot(weights, line) / sum(weights) + 0.5))
    pixels = np.repeat(line.astype(np.uint8)[None, :, None], 3, axis=2)
    got = images.resize_bilinear(pixels, 1, target)[0, :, 0]
    assert np.abs(got - np.array(want)).max() == 0
