"""Perceptual hashes of small grey images, as 64-bit numbers: near images differ in few bits (``text.hamming64``)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _grid(pixels: object, width: int, height: int) -> np.ndarray | None:
    """The image (a flat array of a square, row by row) averaged to ``width`` times ``height``; null if it is no square."""
    if pixels is None:
        return None
    flat = np.asarray(pixels, dtype=float)
    side = int(round(len(flat) ** 0.5))
    if side == 0 or side * side != len(flat):
        return None
    image = flat.reshape(side, side)
    rows = np.minimum(np.arange(height) * side // height, side - 1)
    columns = np.minimum(np.arange(width) * side // width, side - 1)
    return image[np.ix_(rows, columns)]


def _bits(flags: np.ndarray) -> int:
    value = 0
    for f in flags.ravel()[:64]:
        value = value << 1 | int(f)
    return value - (1 << 64) if value >> 63 else value


def _cosines(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def average_hash_of(pixels: object) -> int | None:
    grid = _grid(pixels, 8, 8)
    return None if grid is None else _bits(grid > grid.mean())


def difference_hash_of(pixels: object) -> int | None:
    grid = _grid(pixels, 9, 8)
    return None if grid is None else _bits(grid[:, 1:] > grid[:, :-1])


def frequency_hash_of(pixels: object) -> int | None:
    """Signs of the 64 lowest frequencies against their median, the constant one left out of it."""
    grid = _grid(pixels, 32, 32)
    if grid is None:
        return None
    c = _cosines(32)
    low = (c @ grid @ c.T)[:8, :8]
    return _bits(low > np.median(low.ravel()[1:]))


def _udf(of):
    @F.pandas_udf("long")
    def hashed(images: pd.Series) -> pd.Series:
        return pd.Series([of(x) for x in images], dtype="Int64")

    return hashed


def average_hash(pixels: str | Column) -> Column:
    return _udf(average_hash_of)(pixels)


def difference_hash(pixels: str | Column) -> Column:
    return _udf(difference_hash_of)(pixels)


def frequency_hash(pixels: str | Column) -> Column:
    return _udf(frequency_hash_of)(pixels)
