"""Counts over one whole text: words, symbols, repeated windows, repeated lines; shared by several operators.

Words are the runs of bytes other than 0x20 and 0x09-0x0D, which is what bytes.split() yields for UTF-8.
"""

from __future__ import annotations

import bisect

import numpy as np

SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
WINDOW = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def less(data: bytes, drop: bytes) -> int:
    """How many bytes of data are in drop."""
    return len(data) - len(data.translate(None, drop))


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of `size` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, size):
        out *= _ODD
        out += h[j : j + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    return out


def repeat_words(h: np.ndarray, size: int = WINDOW) -> int:
    """Words that lie in a window of `size` words found twice or more, the first find included."""
    w = windows(h, size)
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(w, twice))
    edge = np.zeros(len(h) + 1, np.int32)
    edge[at] += 1
    edge[at + size] -= 1
    return int(np.count_nonzero(np.cumsum(edge)))


def base_counts(text: str, data: bytes, words: list[bytes], h: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += bool(line.split(None, 1))
        else:
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), less(data, SYMBOLS), dup, repeat_words(h)


class Taken:
    """Stretches of a text that spans have taken, kept apart and in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end)
        return not k or self.ends[k - 1] <= start

    def add(self, start: int, end: int) -> None:
        """Take what free() has said is free."""
        k = bisect.bisect_left(self.starts, end)
        self.starts.insert(k, start)
        self.ends.insert(k, end)
