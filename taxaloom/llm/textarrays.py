"""Texts of an Arrow batch as numpy arrays of code points and words.

Each helper works on a slice of bounded size, so a task holds a few MB whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_CHARS = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(texts: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of at most limit characters; a longer text stands alone. Null reads as empty."""
    first, chars, held = 0, 0, []
    for row, text in enumerate(texts):
        text = text.as_py() or ""
        if held and chars + len(text) > limit:
            yield first, held
            first, chars, held = row, 0, []
        held.append(text)
        chars += len(text)
    if held:
        yield first, held


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the offsets of the texts in it."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE), np.full(n, BASE_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points: a rolling polynomial, then mixed with the length."""
    size = 1 << max(18, int(len(cp) + 1).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(mix(cp.astype(np.uint64) + np.uint64(1)) * up[: len(cp)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of texts: spans, text numbers and hashes."""

    def __init__(self, texts: list[str], lower: bool = False) -> None:
        self.cp, self.offsets = code_points(texts)
        cp, n = self.cp, len(self.cp)
        inside = np.zeros(n + 1, bool)
        inside[:n] = (cp != 32) & ((cp < 9) | (cp > 13))
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (first | ~before))
        self.ends = np.flatnonzero(before & (first | ~inside))
        if lower:
            cp = cp + np.uint32(32) * ((cp >= 65) & (cp <= 90))
        self.hashes = span_hashes(cp, self.starts, self.ends)
        self.doc = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.word_offsets = np.searchsorted(self.starts, self.offsets)


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values by text; 0 for an empty text."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of spans one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
