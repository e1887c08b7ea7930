"""Perceptual hash and structural similarity of 32 x 32 luminance samples, as vectorised functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, LOW, WINDOW = 32, 16, 8
_C1, _C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def _basis() -> np.ndarray:
    """The first rows of the orthonormal cosine basis."""
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    scale = np.where(k == 0, np.sqrt(1 / SIDE), np.sqrt(2 / SIDE))
    return scale * np.cos(np.pi * (2 * n + 1) * k / (2 * SIDE))


_BASIS = _basis()


def hashes(samples: np.ndarray) -> np.ndarray:
    """256-bit hashes (n x 32 bytes) of n x 1024 luminances: a bit for each low frequency above the median of those but the mean."""
    low = np.einsum("ki,nij,lj->nkl", _BASIS, samples.reshape(-1, SIDE, SIDE).astype(np.float64), _BASIS).reshape(-1, LOW * LOW)
    ordered = np.sort(low[:, 1:], axis=1)
    middle = ordered[:, ordered.shape[1] // 2]
    return np.packbits(low > middle[:, None], axis=1)


def ssim(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Percent (rounded half up) of n pairs: the mean over 16 windows of 8 x 8, from 0 to 100."""

    def windows(x: np.ndarray) -> np.ndarray:
        cut = x.reshape(-1, SIDE // WINDOW, WINDOW, SIDE // WINDOW, WINDOW).transpose(0, 1, 3, 2, 4)
        return cut.reshape(-1, (SIDE // WINDOW) ** 2, WINDOW * WINDOW).astype(np.float64)

    x, y = windows(a), windows(b)
    mx, my = x.mean(2), y.mean(2)
    vx, vy = x.var(2, ddof=1), y.var(2, ddof=1)
    cov = ((x - mx[..., None]) * (y - my[..., None])).sum(2) / (WINDOW * WINDOW - 1)
    each = ((2 * mx * my + _C1) * (2 * cov + _C2)) / ((mx**2 + my**2 + _C1) * (vx + vy + _C2))
    return np.floor(np.clip(each.mean(1), 0, 1) * 100 + 0.5).astype(np.int32)


class Windows:
    """The 16 windows of n samples by window: pixels, means and variances.

    Pixels are whole numbers, and sums of 64 products of two are below 2 ** 24: single precision holds them exactly.
    """

    def __init__(self, samples: np.ndarray):
        side = SIDE // WINDOW
        cut = samples.reshape(-1, side, WINDOW, side, WINDOW).transpose(1, 3, 0, 2, 4)
        self.pixels = np.ascontiguousarray(cut.astype(np.float32)).reshape(side * side, -1, WINDOW * WINDOW)
        total = self.pixels.sum(2).astype(np.float64)
        squares = np.einsum("wnp,wnp->wn", self.pixels, self.pixels).astype(np.float64)
        self.mean, n = total / (WINDOW * WINDOW), WINDOW * WINDOW
        self.variance = (squares - total * total / n) / (n - 1)


#: From this share of wanted pairs on, products of all rows with all others (a matrix product) cost less than those of the wanted.
DENSE = 0.02


def percents(a: Windows, b: Windows, rows, others, i: np.ndarray, j: np.ndarray, dense: float = DENSE, at_once: int = 1 << 15) -> np.ndarray:
    """``ssim`` of the i-th of ``rows`` of a with the j-th of ``others`` of b (rows, others: indices or slices)."""
    n = WINDOW * WINDOW
    total = np.zeros(len(i))
    width, height = len(b.mean[0][others]), len(a.mean[0][rows])
    full = len(i) > dense * width * height
    flat = i * width + j if full else None
    for w in range(len(a.pixels)):
        left, right = a.pixels[w][rows], b.pixels[w][others]
        ma, mb, va, vb = a.mean[w][rows], b.mean[w][others], a.variance[w][rows], b.variance[w][others]
        product = (left @ right.T).ravel() if full else None
        for k in range(0, len(i), at_once):
            x, y = i[k : k + at_once], j[k : k + at_once]
            sums = product.take(flat[k : k + at_once]) if full else np.einsum("kp,kp->k", left[x], right[y])
            mx, my = ma.take(x), mb.take(y)
            both = mx * my
            cov = (sums.astype(np.float64) - both * n) / (n - 1)
            top = (both * 2 + _C1) * (cov * 2 + _C2)
            total[k : k + at_once] += top / ((mx * mx + my * my + _C1) * (va.take(x) + vb.take(y) + _C2))
    return np.floor(np.clip(total / len(a.pixels), 0, 1) * 100 + 0.5).astype(np.int32)


def _stack(column: pd.Series) -> np.ndarray:
    wrong = [len(s) for s in column if len(s) != SIDE * SIDE]
    if wrong:
        raise ValueError(f"a sample has {wrong[0]} bytes, not {SIDE * SIDE}")
    return np.frombuffer(b"".join(bytes(s) for s in column), np.uint8).reshape(-1, SIDE * SIDE)


@F.pandas_udf(T.BinaryType())
def perceptual_hash(sample: pd.Series) -> pd.Series:
    return pd.Series([h.tobytes() for h in hashes(_stack(sample))]) if len(sample) else pd.Series([], dtype=object)


@F.pandas_udf(T.IntegerType())
def ssim_percent(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ssim(_stack(a), _stack(b))) if len(a) else pd.Series([], dtype="int32")


def hash_words(column):
    """The four 64-bit words of a 32-byte hash."""
    return [F.conv(F.hex(F.substring(column, 1 + 8 * i, 8)), 16, -10).cast("long").alias(f"w{i}") for i in range(4)]
