"""Image bytes to sizes, pixels and model input.

Sizes come from header bytes. Pixels come from a decoder: Pillow where the cluster
has it, else a reader for plain 8-bit PNG files, else one that the caller gives.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from framekiln.functions.pieces import pieces

# Channel statistics that the vision encoder was trained with.
VISION_MEAN = (0.485, 0.456, 0.406)
VISION_STD = (0.229, 0.224, 0.225)
VISION_SIDE = 224

Decoder = Callable[[bytes], np.ndarray]


def header_size(data: bytes) -> tuple[int, int] | None:
    """(height, width) from a PNG or JPEG header; None when it is neither."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        width, height = struct.unpack(">II", data[16:24])
        return height, width
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        # Frame headers are C0..CF but for the table markers C4, C8 and CC.
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return height, width
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def png_pixels(data: bytes) -> np.ndarray:
    """RGB pixels (height, width, 3) of an 8-bit, non-interlaced grey, RGB or RGBA PNG."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[6] != 0 or head[3] not in (0, 2, 6):
        raise ValueError("only 8-bit, non-interlaced grey, RGB and RGBA PNG files are read here")
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    rows = raw.reshape(height, 1 + width * channels)
    out = np.zeros((height + 1, width + 1, channels), np.int32)
    for y in range(height):
        kind = rows[y, 0]
        line = rows[y, 1:].reshape(width, channels).astype(np.int32)
        up = out[y]
        if kind == 0:
            out[y + 1, 1:] = line
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0) & 255
        elif kind == 2:
            out[y + 1, 1:] = (line + up[1:]) & 255
        else:
            for x in range(width):
                left, above, corner = out[y + 1, x], up[x + 1], up[x]
                if kind == 3:
                    guess = (left + above) >> 1
                else:
                    near = left + above - corner
                    a, b, c = abs(near - left), abs(near - above), abs(near - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
                out[y + 1, x + 1] = (line[x] + guess) & 255
    pixels = out[1:, 1:].astype(np.uint8)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else np.ascontiguousarray(pixels[:, :, :3])


def default_decoder() -> Decoder:
    """Pillow, with truncated files accepted, or the PNG reader where it is absent."""
    try:
        import io

        from PIL import Image, ImageFile
    except ImportError:
        return png_pixels
    ImageFile.LOAD_TRUNCATED_IMAGES = True
    return lambda data: np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


def _triangle(size: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Source places and weights (target x taps), widened when shrinking so that no pixel is skipped."""
    step = size / target
    reach = max(step, 1.0)
    centres = (np.arange(target) + 0.5) * step
    first = np.floor(centres - reach).astype(int)
    places = first[:, None] + np.arange(int(np.ceil(2 * reach)) + 2)
    weights = np.clip(1.0 - np.abs(places + 0.5 - centres[:, None]) / reach, 0.0, None)
    weights[(places < 0) | (places >= size)] = 0.0
    return np.clip(places, 0, size - 1), weights / weights.sum(axis=1, keepdims=True)


def _cubic(size: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Source places and weights (target x 4) of cubic convolution with a = -0.75, edges repeated."""
    a = -0.75
    at = (np.arange(target) + 0.5) * size / target - 0.5
    places = np.floor(at).astype(int)[:, None] + np.arange(-1, 3)
    d = np.abs(at[:, None] - places)
    near = ((a + 2) * d - (a + 3)) * d * d + 1
    far = ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return np.clip(places, 0, size - 1), np.where(d <= 1, near, far)


def _weighted(x: np.ndarray, axis: int, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
    shape = [1] * x.ndim
    shape[axis] = len(places)
    return sum(np.take(x, places[:, k], axis) * weights[:, k].reshape(shape) for k in range(places.shape[1]))


def resize_bilinear(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Stretch 8-bit pixels to (height, width), rounding after each direction."""

    def rounded(x: np.ndarray) -> np.ndarray:
        return np.floor(np.clip(x, 0.0, 255.0) + 0.5).clip(0, 255)

    x = pixels.astype(np.float64)
    if width != x.shape[1]:
        x = rounded(_weighted(x, 1, *_triangle(x.shape[1], width)))
    if height != x.shape[0]:
        x = rounded(_weighted(x, 0, *_triangle(x.shape[0], height)))
    return x.astype(np.uint8)


def resize_bicubic(channels_first: np.ndarray, height: int, width: int) -> np.ndarray:
    """Cubic resize of a (channel, height, width) float array, without smoothing."""
    tall = _weighted(channels_first, 1, *_cubic(channels_first.shape[1], height))
    return _weighted(tall, 2, *_cubic(channels_first.shape[2], width))


def model_input(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pixels stretched to the bin's size, channel first, in -1..1."""
    x = resize_bilinear(pixels, height, width).astype(np.float32) / np.float32(255.0)
    return (np.moveaxis(x, -1, 0) - np.float32(0.5)) / np.float32(0.5)


def vision_input(model_pixels: np.ndarray, side: int = VISION_SIDE) -> np.ndarray:
    """Model input turned into the vision encoder's square, standardised input."""
    x = resize_bicubic((model_pixels.astype(np.float32) + 1.0) / 2.0, side, side)
    mean, std = np.array(VISION_MEAN)[:, None, None], np.array(VISION_STD)[:, None, None]
    return ((x - mean) / std).astype(np.float32)


def image_size(image: Column) -> Column:
    """``struct<height, width>`` from header bytes; nulls for an unknown format.

    The shard scan gives the same without sending bytes to another task; this is for
    images that come from other tables.
    """

    @F.pandas_udf("height int, width int")
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for images in batches:
            found = [header_size(b) if b is not None else None for b in images]
            yield pd.DataFrame(
                {
                    "height": pd.array([f[0] if f else None for f in found], dtype="Int32"),
                    "width": pd.array([f[1] if f else None for f in found], dtype="Int32"),
                }
            )

    return sizes(image)


PIXELS = "struct<pixels: array<float>, _error: string>"


def decode_image(image: Column, decoder: Callable[[], Decoder] = default_decoder) -> Column:
    """RGB pixels as a flat height x width x channel array, or ``_error``."""

    @F.pandas_udf(PIXELS)
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decode = decoder()

        def row(data: bytes) -> tuple:
            try:
                return decode(data).astype(np.float32).ravel(), None
            except Exception as problem:
                return None, f"{type(problem).__name__}: {problem}"

        for images in batches:
            for rows in pieces(map(row, images)):
                yield pd.DataFrame(rows, columns=["pixels", "_error"])

    return decoded(image)


def transform_image(
    image: Column, height: Column, width: Column, decoder: Callable[[], Decoder] = default_decoder
) -> Column:
    """Decoded, stretched to the bin's size and normalised, as a flat channel-first array, or ``_error``."""

    @F.pandas_udf(PIXELS)
    def transformed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        decode = decoder()

        def row(data: bytes, height: int, width: int) -> tuple:
            try:
                return model_input(decode(data), int(height), int(width)).ravel(), None
            except Exception as problem:
                return None, f"{type(problem).__name__}: {problem}"

        for images, heights, widths in batches:
            for rows in pieces(map(row, images, heights, widths)):
                yield pd.DataFrame(rows, columns=["pixels", "_error"])

    return transformed(image, height, width)


def from_image_source(image: Column) -> Column:
    """RGB pixels, flat height x width x channel, of a row of Spark's ``image`` source.

    That source stores blue, green, red (and maybe alpha) bytes, or grey ones.
    """

    def row(data: bytes, channels: int) -> np.ndarray:
        x = np.frombuffer(data, np.uint8).reshape(-1, channels)
        x = np.repeat(x, 3, axis=1) if channels == 1 else x[:, 2::-1]
        return x.astype(np.float32).ravel()

    @F.pandas_udf("array<float>")
    def rgb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for images in batches:
            for out in pieces(map(row, images["data"], images["nChannels"])):
                yield pd.Series(out)

    return rgb(image)
