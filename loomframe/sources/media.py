"""Pixels and durations read from bytes: a plain raster format, resizing, and the box tree of MP4 files. Small helpers of Arrow batches."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.text import ERROR

#: The size that encoders take, the reply for an image that cannot be read, and the side of what stands in its place.
SIDE, UNREADABLE, BLANK = 224, f"{ERROR}: image_open_failed", 32

_HEADER = re.compile(rb"(P[56])" + rb"(?:\s|#[^\n]*\n)+(\d{1,6})" * 3 + rb"\s")


def decode(content: bytes) -> np.ndarray:
    """(height, width, 3) bytes of a binary PGM (grey) or PPM (colour) image; comments in the header are skipped, a smaller range is stretched to 255."""
    head = _HEADER.match(content or b"")
    if not head:
        raise ValueError("not a PGM or PPM image")
    width, height, top = (int(x) for x in head.groups()[1:])
    channels = 3 if head[1] == b"P6" else 1
    n = width * height * channels
    if not 0 < top < 256 or not n or len(content) - head.end() < n:
        raise ValueError("a truncated or unsupported image")
    x = np.frombuffer(content, np.uint8, n, head.end()).reshape(height, width, channels)
    if top < 255:
        x = np.rint(np.minimum(x, top) * (255.0 / top)).astype(np.uint8)
    return np.repeat(x, 3, axis=2) if channels == 1 else x


def axis(n: int, side: int = SIDE) -> np.ndarray:
    """(side, n): the weights by which n places make `side`, between neighbours, with centres on centres."""
    at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    out = np.zeros((side, n))
    np.add.at(out, (np.arange(side), low), 1 - (at - low))
    np.add.at(out, (np.arange(side), np.minimum(low + 1, n - 1)), at - low)
    return out


def resize(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """(side, side, 3): one product for rows, one for columns."""
    return np.einsum("yh,hwc,xw->yxc", axis(image.shape[0], side), image.astype(np.float64), axis(image.shape[1], side), optimize=True)


def patch_encoder(weight: np.ndarray, rows: int = 4, columns: int = 8, side: int = SIDE) -> Callable[[], Callable[[bytes], list[list[float]]]]:
    """An encoder for encode_images: the image's mean colours over a grid, through a linear map weight (width, 3); rows * columns rows."""

    def make() -> Callable[[bytes], list[list[float]]]:
        def encode(content: bytes) -> list[list[float]]:
            x = resize(decode(content), side)
            means = x.reshape(rows, side // rows, columns, side // columns, 3).mean(axis=(1, 3)).reshape(rows * columns, 3)
            return (means @ weight.T).tolist()

        return encode

    return make


def reply_to_images(images: DataFrame, make: Callable[[], Callable[[list[np.ndarray]], list[str]]], batch_size: int = 8, name: str = "reply") -> DataFrame:
    """images(content, ...) without content, plus the reply to each image.

    An image that cannot be read goes to the model as a blank one, so that its batch is whole, and gets the marker as reply; if the model fails, each row of
    the batch gets the error, unless its image could not be read.
    """
    kept = [f for f in images.schema if f.name != "content"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for x in frames:
            for i in range(0, len(x), batch_size):
                part, pixels, ok = x.iloc[i : i + batch_size], [], []
                for content in part["content"]:
                    try:
                        pixels.append(decode(content))
                        ok.append(True)
                    except (ValueError, TypeError):
                        pixels.append(np.zeros((BLANK, BLANK, 3), np.uint8))
                        ok.append(False)
                try:
                    replies = model(pixels)
                except Exception as e:  # noqa: BLE001  the error is the rows' result
                    replies = [f"{ERROR}: {type(e).__name__}: {e}"] * len(part)
                yield part.drop(columns="content").assign(**{name: [r if k else UNREADABLE for r, k in zip(replies, ok, strict=True)]})

    return images.mapInPandas(run, StructType([*kept, StructField(name, StringType())]))


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end of content) of the boxes of a range; sizes of 32 and 64 bits, and 0 for up to the end. Stops at a box that is cut off."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        elif size == 0:
            size = end - at
        if size < head:
            return
        yield kind, at + head, min(at + size, end)
        at += size


def movie_seconds(data: bytes | None) -> float:
    """The duration that the movie header in the first bytes of an MP4 file gives; 0 where there is none, or it is cut off or unknown."""
    data = bytes(data or b"")
    for kind, start, end in boxes(data, 0, len(data)):
        if kind != b"moov":
            continue
        for inner, a, b in boxes(data, start, end):
            layout = {0: ">8xII", 1: ">16xIQ"}.get(data[a] if a < b else -1)  # times of creation and change are skipped
            if inner == b"mvhd" and layout and b - a >= 4 + struct.calcsize(layout):
                scale, duration = struct.unpack_from(layout, data, a + 4)
                unknown = duration == (1 << (64 if data[a] else 32)) - 1
                return 0.0 if unknown or not scale else duration / scale
    return 0.0


@F.pandas_udf(DoubleType())
def seconds_of(head: pd.Series) -> pd.Series:
    """movie_seconds of a binary column."""
    return head.map(movie_seconds)
