"""Character n-grams that a text shares with every text that holds it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

#: Characters of an n-gram, and how many n-grams in a row give one between them.
SIZE, WINDOW = 8, 16
#: Texts of at least so many characters have a least n-gram of a whole window.
LONG = SIZE + WINDOW - 1
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def hashes(text: str, size: int) -> np.ndarray:
    """A 64-bit hash of each n-gram of `size` characters, in order: of halves where they are equal, else one character more."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(code) < size:
        return np.empty(0, np.int64)

    def of(n: int) -> np.ndarray:
        if n == 1:
            return code + np.uint64(size)
        part = of(n // 2)
        h = (part[: len(part) - n // 2] * _ODD) ^ part[n // 2 :]
        h *= _MIX
        return h if n % 2 == 0 else (h[:-1] * _ODD) ^ code[n - 1 :]

    h = of(size)
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h.view(np.int64)


def least(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The least of each `window` hashes in a row, by halves of the window."""
    done = 1
    while done < window:
        step = min(done, window - done)
        h = np.minimum(h[:-step], h[step:])
        done += step
    return h


class Keys:
    """Different hashes of a text: all n-grams of the given sizes, all of SIZE characters (every), or the least of each window
    of those; with `only`, those among these. A text holds another only if it has all of the other's keys of the same kind: an
    n-gram and the least one of a window depend on nothing outside them."""

    BITS = 20

    def __init__(self, sizes: tuple[int, ...] = (), every: bool = False, windows: bool = False, only: np.ndarray | None = None):
        self.sizes, self.every, self.windows, self.only = sizes, every, windows, only
        if only is not None:  # most hashes are told apart by their last bits
            self.may = np.zeros(1 << self.BITS, bool)
            self.may[only & ((1 << self.BITS) - 1)] = True

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        out = [hashes(text, n) for n in self.sizes]
        if self.every or self.windows:
            h = hashes(text, SIZE)
            if not self.every:
                h = least(h) if len(h) >= WINDOW else h[:0]
                h = np.r_[h[np.flatnonzero(h[1:] != h[:-1])], h[-1:]]
            out.append(h)
        if self.only is not None:
            out = [h[self.may[h & ((1 << self.BITS) - 1)]] for h in out]
        found = np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)
        return found if self.only is None else found[np.isin(found, self.only, assume_unique=True)]


def keyed(text: Column, make: Callable[[str | None], np.ndarray]) -> Column:
    """make(text) as array<long>."""

    @F.pandas_udf(ArrayType(LongType()))
    def udf(texts: pd.Series) -> pd.Series:
        return texts.map(make)

    return udf(text)
