"""Whole-number vectors and their exact inner products, which the searches share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length of a vector beyond which squares could overflow.
HUGE = 2.0**100
LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Sums of whole numbers below this are exact.
EXACT = 2.0**52


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(False))


def whole(x, scale: float) -> np.ndarray:
    """floor(scale * x); the largest double of its sign where that is no double."""
    with np.errstate(over="ignore"):
        y = scale * np.asarray(x, np.float64)
    return np.floor(np.clip(y, -np.finfo(np.float64).max, np.finfo(np.float64).max)) + 0.0


def spans(x: np.ndarray) -> np.ndarray:
    """An upper bound of each row's length, which can't overflow unless the row is HUGE by far."""
    with np.errstate(over="ignore"):
        return np.abs(x).max(1, initial=0.0) * np.sqrt(max(x.shape[1], 1))


def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as longs; the nearest long where they don't fit."""
    la, lc = (np.minimum(spans(x), EXACT) for x in (a, c))
    if la.max(initial=0.0) * lc.max(initial=0.0) < EXACT:  # all partial sums are whole numbers that a double holds
        return (a @ c.T).astype(np.int64)
    out = np.zeros((len(a), len(c)), np.int64)
    i, j = la * lc.max() < EXACT, lc * la.max() < EXACT
    for rows, cols in ((i, np.full(len(c), True)), (~i, j)):
        if rows.any() and cols.any():
            out[np.ix_(rows, cols)] = (a[rows] @ c[cols].T).astype(np.int64)
    if not (i.all() or j.all()):
        ints = lambda x: np.array([int(y) for y in x.ravel()], object).reshape(x.shape)
        out[np.ix_(~i, ~j)] = np.clip(ints(a[~i]) @ ints(c[~j]).T, LOW, HIGH).astype(np.int64)
    return out


def matrices(f: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of each length with their vectors (v) as one matrix."""
    for size, own in f.groupby(f.v.map(len)):
        yield own.reset_index(drop=True), np.concatenate([*own.v, np.zeros(0)]).astype(np.float64).reshape(len(own), size)
