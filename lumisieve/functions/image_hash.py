"""Perceptual hashes of whole rasters, as Arrow-batched functions.

``hash_of(raster, "phash", 8)`` takes a column ``struct<width,height,channels,data>`` and gives a hash's text;
``crop_resistant(raster)`` gives an array of texts, one for each segment. A raster that can't be hashed gives null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import raster as R

SNAP, ROBUST = 1e-10, 1e-12
ALGORITHMS = ("average", "difference", "difference_vertical", "phash", "phash_simple", "whash_haar", "whash_db4", "whash_db4_robust", "colour")
SEGMENT_SIDE = 300


def text_of(bits: np.ndarray) -> str:
    flat = bits.astype(np.uint8).ravel()
    return np.packbits(np.concatenate([np.zeros(-len(flat) % 8, np.uint8), flat])).tobytes().hex()[-(-(-len(flat) // 4)) :]


def pixels_of(width: int, height: int, channels: int, data: bytes) -> np.ndarray:
    if width <= 0 or height <= 0 or channels not in (3, 4) or len(data) != width * height * channels:
        raise ValueError("a raster's bytes must be width x height x channels")
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def _sized(size: int, power: bool = False) -> int:
    if size < 2 or power and size & (size - 1):
        raise ValueError("a hash's side must be at least 2" + ", and a power of 2" * power)
    return size


def average(gray: np.ndarray, n: int) -> np.ndarray:
    small = R.resized(gray, _sized(n), n)
    return small > small.mean()


def difference(gray: np.ndarray, n: int, vertical: bool = False) -> np.ndarray:
    small = R.resized(gray, _sized(n) + (not vertical), n + vertical).astype(int)
    return (small[1:] > small[:-1]) if vertical else (small[:, 1:] > small[:, :-1])


def phash(gray: np.ndarray, n: int, factor: int = 4) -> np.ndarray:
    small = R.resized(gray, _sized(n) * factor, n * factor)
    low = R.dct(R.dct(small, 0)[:, :], 1)[:n, :n]
    return low > np.median(low) + SNAP


def phash_simple(gray: np.ndarray, n: int, factor: int = 4) -> np.ndarray:
    small = R.resized(gray, _sized(n) * factor, n * factor)
    low = R.dct(small[:n], 1)[:, 1 : n + 1]
    return low > np.add.accumulate(low.ravel())[-1] / low.size + SNAP


def wavelet(gray: np.ndarray, n: int, kind: str = "haar", robust: bool = False) -> np.ndarray:
    side = max(1 << int(math.log2(min(gray.shape))), _sized(n, power=True))
    deepest = side.bit_length() - 1
    flat = R.without_mean(R.resized(gray, side, side) / 255.0, deepest)
    levels = deepest - (n.bit_length() - 1)
    low = R.haar_levels(flat, levels)[0] if kind == "haar" else R.db4_low(flat, levels)
    if robust:
        low = np.where(np.abs(low) < ROBUST, 0.0, low)
    return low > np.median(low) + (SNAP if kind != "haar" else 0.0)


def colour(rgb: np.ndarray, bits: int) -> np.ndarray:
    """14 values: black, gray, six faint and six bright hues."""
    if not 1 <= bits <= 30:
        raise ValueError("a colour hash takes 1 to 30 bits a value")
    h, s, _ = R.hsv(rgb)
    black = R.luma(rgb).ravel() < 32
    gray, hue = ~black & (s < 85), np.minimum(5, h * 6 // 255)
    rest, room = ~black & ~gray, 1 << bits
    n, coloured = black.size, max(1, int(rest.sum()))
    counts = [*np.bincount(hue[rest & (s < 170)], minlength=6), *np.bincount(hue[rest & (s > 170)], minlength=6)]
    values = [min(room - 1, int(c / n * room)) for c in (int(black.sum()), int(gray.sum()))] + [min(room - 1, int(int(c) * room / coloured)) for c in counts]
    return np.array([[(v >> (bits - i - 1)) & ((1 << (bits - i)) - 1) > 0 for i in range(bits)] for v in values])


def bits_of(pixels: np.ndarray, algorithm: str, size: int) -> np.ndarray:
    rgb = R.composited(pixels)
    if algorithm == "colour":
        return colour(rgb, size)
    gray = R.luma(rgb)
    if algorithm == "average":
        return average(gray, size)
    if algorithm.startswith("difference"):
        return difference(gray, size, algorithm.endswith("vertical"))
    if algorithm == "phash":
        return phash(gray, size)
    if algorithm == "phash_simple":
        return phash_simple(gray, size)
    if algorithm.startswith("whash"):
        return wavelet(gray, size, algorithm.split("_")[1], algorithm.endswith("robust"))
    raise ValueError(f"no algorithm {algorithm}")


def crops(pixels: np.ndarray, limit: int | None = None, threshold: float = 128, least_size: int = 500, side: int = SEGMENT_SIDE) -> list[tuple[int, int, int, int]]:
    """(left, top, right, bottom) in the whole raster of its segments, largest first if there is a limit."""
    h, w = pixels.shape[:2]
    gray = R.median3(R.blurred(R.resized(R.luma(R.composited(pixels)), side, side)))
    found = R.segments(gray.astype(np.float32), threshold, least_size) or [(0, (0, 0, side - 1, side - 1))]
    if limit is not None:
        found = sorted(found, key=lambda s: -s[0])[:limit]
    out = []
    for _, (top, left, bottom, right) in found:
        box = [round(left * (w / side)), round(top * (h / side)), round((right + 1) * (w / side)), round((bottom + 1) * (h / side))]
        box = [max(0, box[0]), max(0, box[1]), min(w, box[2]), min(h, box[3])]
        if box[2] > box[0] and box[3] > box[1]:
            out.append(tuple(box))
    return out


def hash_of(raster: Column, algorithm: str, size: int = 8) -> Column:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"no algorithm {algorithm}")

    @F.pandas_udf("string")
    def run(images: pd.DataFrame) -> pd.Series:
        return pd.Series([_text(i, lambda p: text_of(bits_of(p, algorithm, size))) for i in images.itertuples(index=False)], dtype=object)

    return run(raster)


def crop_resistant(raster: Column, limit: int | None = None, threshold: float = 128, least_size: int = 500, algorithm: str = "difference", size: int = 8, side: int = SEGMENT_SIDE) -> Column:
    @F.pandas_udf("array<string>")
    def run(images: pd.DataFrame) -> pd.Series:
        each = lambda p: [text_of(bits_of(p[t:b, x:r], algorithm, size)) for x, t, r, b in crops(p, limit, threshold, least_size, side)]
        return pd.Series([_text(i, each) for i in images.itertuples(index=False)], dtype=object)

    return run(raster)


def _text(image, make):
    try:
        return make(pixels_of(int(image.width), int(image.height), int(image.channels), bytes(image.data)))
    except (TypeError, ValueError):
        return None
