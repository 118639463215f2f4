"""Jaro-Winkler similarity (Winkler 1990) of string pairs, one Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published measure.
PREFIX, SCALE, BOOST_ABOVE = 4, 0.1, 0.7


def char_codes(strings) -> tuple[np.ndarray, np.ndarray]:
    """The characters of each string, 0 behind its end, and the lengths."""
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    width = int(lengths.max(initial=0))
    flat = np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32)
    codes = np.zeros((len(lengths), width), dtype=np.uint32)
    codes[np.arange(width) < lengths[:, None]] = flat
    return codes, lengths


def _packed(codes: np.ndarray, hit: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """The characters at the hits of each row, in order from the left; every row has ``count`` of them."""
    out = np.zeros((len(codes), width), codes.dtype)
    out[np.arange(width) < count[:, None]] = codes[hit]
    return out


def similarity(left, right) -> np.ndarray:
    """Scores of pairs of non-empty strings."""
    a, la = char_codes(left)
    b, lb = char_codes(right)
    # Small numbers, many of which are compared at once.
    if max(a.max(initial=0), b.max(initial=0)) < 256:
        a, b = a.astype(np.uint8), b.astype(np.uint8)
    small = np.int8 if max(a.shape[1], b.shape[1]) < 128 else np.int64
    n, cols = len(la), np.arange(b.shape[1], dtype=small)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0).astype(small)
    free = np.arange(b.shape[1]) < lb[:, None]
    used = np.zeros(a.shape, dtype=bool)
    rows = np.arange(n)
    for i in range(a.shape[1]):
        fits = free & (b == a[:, i : i + 1]) & (np.abs(cols - small(i)) <= reach[:, None])
        first = fits.argmax(axis=1)
        hit = fits[rows, first] & (i < la)
        used[:, i] = hit
        free[rows[hit], first[hit]] = False
    matched = used.sum(axis=1)
    taken = (np.arange(b.shape[1]) < lb[:, None]) & ~free
    k = int(matched.max(initial=0))
    seq_a, seq_b = (_packed(x, hit, matched, k) for x, hit in ((a, used), (b, taken)))
    moved = ((seq_a != seq_b) & (np.arange(k) < matched[:, None])).sum(axis=1) // 2
    m = np.maximum(matched, 1)
    jaro = np.where(matched > 0, (m / la + m / lb + (m - moved) / m) / 3, 0.0)
    width = min(PREFIX, a.shape[1], b.shape[1])
    same = (a[:, :width] == b[:, :width]) & (np.arange(width) < np.minimum(la, lb)[:, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1) if width else np.zeros(n)
    return np.where(jaro > BOOST_ABOVE, jaro + prefix * SCALE * (1 - jaro), jaro)


def jaro_winkler(left: Column, right: Column) -> Column:
    """F-23 for one pair of strings per row; 0 if either is empty or null."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a))
        ok = (a.fillna("").str.len().gt(0) & b.fillna("").str.len().gt(0)).to_numpy()
        if ok.any():
            out[ok] = similarity(list(a[ok]), list(b[ok]))
        return pd.Series(out)

    return score(left, right)
