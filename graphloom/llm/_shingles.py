"""Word shingles as hashes, computed on whole texts with numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

WORDS = 5
BLOCK = 1 << 22
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_random = np.random.default_rng(20240607)
#: A random value for each byte, A-Z as a-z.
_VALUE = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
CASED = _VALUE.copy()
_VALUE[65:91] = _VALUE[97:123]
_PLACE = _random.integers(0, 1 << 64, 8, dtype=np.uint64) | np.uint64(1)
_BASE, _INVERSE = 0x9E3779B97F4A7C17, pow(0x9E3779B97F4A7C17, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n of them at least."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end at a blank."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + BLOCK)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def word_hashes(text: bytes, value: np.ndarray = _VALUE) -> np.ndarray:
    """A hash for each word of the text, in order; with ``CASED``, A-Z aren't a-z."""
    out = []
    for part in pieces(text):
        b = np.frombuffer(part, np.uint8)
        blank = _BLANK[b]
        edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            up, down = _grown(len(b))
            total = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(value[b] * up[: len(b)], out=total[1:])
            out.append(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the text's 5-word shingles; of its whole word sequence if that is shorter."""
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w
    return np.unique(spread_windows(w, min(n, WORDS)))


def spread_windows(w: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of ``size`` hashes."""
    total = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        total += w[k : len(w) - size + 1 + k] * _PLACE[k]
    return mix(total)
