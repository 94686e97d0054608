"""Images as pixel arrays: variance of the Laplacian, and the list of blurred ones."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def laplacian_variance(pixels: pd.Series) -> pd.Series:
    """Population variance of the 4-neighbour Laplacian of a grey image (array<array<double>>), edges mirrored; null for an empty one."""

    def one(rows) -> float | None:
        if rows is None or not len(rows) or not len(rows[0]):
            return None
        p = np.pad(np.array([np.asarray(r, float) for r in rows]), 1, mode="reflect" if min(len(rows), len(rows[0])) > 1 else "edge")
        out = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
        return float(out.var())

    return pixels.map(one)


def _grey_map(data: bytes) -> np.ndarray | None:
    """A binary grey map (P5, one byte a pixel)."""
    head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+\d+\s", data)
    if not head:
        return None
    width, height = int(head[1]), int(head[2])
    return np.frombuffer(data, np.uint8, width * height, head.end()).reshape(height, width).astype(float)


#: Fixed values of the PNG format: samples a pixel by colour type.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _png(data: bytes) -> np.ndarray | None:
    """A PNG of eight-bit samples without interlace, as grey; colours are weighed as eyes see them, transparency is ignored."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(float)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in _SAMPLES or head[6]:
        return None
    width, height, step = head[0], head[1], _SAMPLES[head[3]]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)[: height * (width * step + 1)].reshape(height, width * step + 1)
    out = np.zeros((height + 1, width + 1, step), np.int64)  # a row above and a pixel to the left, both 0
    for y in range(height):
        kind, x = int(rows[y, 0]), rows[y, 1:].reshape(width, step).astype(np.int64)
        above, own = out[y], out[y + 1]
        if kind == 0:
            own[1:] = x
        elif kind == 1:
            own[1:] = np.cumsum(x, axis=0) & 255
        elif kind == 2:
            own[1:] = x + above[1:] & 255
        else:  # a byte depends on the one to its left
            for i in range(1, width + 1):
                a, b, c = own[i - 1], above[i], above[i - 1]
                if kind == 3:
                    guess = a + b >> 1
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
                own[i] = x[i - 1] + guess & 255
    pixels = out[1:, 1:].astype(float)
    if palette is not None and head[3] == 3:
        pixels = palette[pixels[:, :, 0].astype(int)]
    return (pixels[:, :, :3] @ [299.0, 587.0, 114.0] + 500) // 1000 if pixels.shape[2] >= 3 else pixels[:, :, 0]


def read_grey(files: DataFrame) -> DataFrame:
    """path, pixels: binary grey maps and eight-bit PNGs as rows of grey values; files of other kinds and broken ones have null pixels."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def pixels(content: pd.Series) -> pd.Series:
        def one(data: bytes | None):
            try:
                found = next((p for p in (_grey_map(bytes(data or b"")), _png(bytes(data or b""))) if p is not None), None)
            except (ValueError, IndexError, struct.error, zlib.error):
                return None
            return None if found is None else found.tolist()

        return pd.Series([one(c) for c in content], dtype=object)

    return files.select("path", pixels("content").alias("pixels"))


def is_blurred(variance: Column, threshold: float = 100.0) -> Column:
    return variance < threshold


def deletion_manifest(images: DataFrame, threshold: float = 100.0) -> DataFrame:
    """path, variance of the images that a caller may want to delete; nothing is deleted here."""
    return images.select("path", laplacian_variance("pixels").alias("variance")).where(is_blurred(F.col("variance"), threshold))
