"""Words and word n-grams of many texts at once, as 64-bit hashes over Arrow's byte buffers."""

from __future__ import annotations

import numpy as np

_LETTERS = np.arange(256)
#: Byte classes: what may stand in a word. Upper and lower ASCII letters share a hash value, which lower-cases for free.
NOT_SPACE = ~np.isin(_LETTERS, [0x20, *range(0x09, 0x0E)])
LOWER = np.where((_LETTERS >= 0x41) & (_LETTERS <= 0x5A), _LETTERS + 32, _LETTERS).astype(np.uint8)
ALPHANUMERIC = (_LETTERS >= 0x80) | np.isin(_LETTERS, [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_VALUES = np.random.default_rng(0x5EED).integers(1 << 62, 1 << 63, 256, np.uint64)
_VALUES[0x41:0x5B] = _VALUES[0x61:0x7B]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64; they grow to the longest slice seen."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 19)
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, _BASE_INVERSE)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                _powers[i] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def word_bounds(raw: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end in raw, and the n+1 offsets of each text's words. No word spans two texts."""
    is_in = inside[raw]
    first, last = is_in.copy(), is_in.copy()
    if len(raw):
        first[1:] &= ~is_in[:-1]
        last[:-1] &= ~is_in[1:]
        edges = np.unique(off[(off > 0) & (off < len(raw))])
        first[edges] = is_in[edges]
        last[edges - 1] = is_in[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, equal for words that differ in the case of ASCII letters only."""
    up, down = _power(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUES[raw] * up[: len(raw)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
    return mixed(h)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, by the place of the first; those that span texts are for the caller to drop."""
    m = max(0, len(h) - n + 1)
    with np.errstate(over="ignore"):
        g = np.full(m, n, np.uint64)
        for i in range(n):
            g *= _GRAM
            g += h[i : i + m]
    return mixed(g)


def whole(offsets: np.ndarray, m: int, n: int) -> np.ndarray:
    """Which of m n-grams lie within one text."""
    ok = np.ones(m, bool)
    if n > 1:
        ends = offsets[1:]
        for i in range(1, n):
            e = ends - i
            ok[e[(e >= 0) & (e < m)]] = False
    return ok
