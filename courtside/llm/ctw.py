"""Context-tree weighting over bytes, as array arithmetic: estimates, bottom-up weights, top-down mixing.

A gram is `depth` context bytes and the byte that follows, packed into 64 bits with the most recent context byte first:
the leading d bytes are then the context of depth d, and a subtree is a range of keys. The following byte is decomposed
into 8 binary decisions; decision k stands at node (1 << k) | (its first k bits), so each context has up to 255 nodes, and
each node number has a context tree of its own. A node of a tree at depth d is written as the context's d bytes and the
node number.
"""

from __future__ import annotations

import numpy as np

EDGE = 0xFF  # no UTF-8 text holds it: pads a text's start and ends it
_TABLE = 4096
_LOG_HALF = np.concatenate([[0.5 * np.log(np.pi)], 0.5 * np.log(np.pi) + np.cumsum(np.log(np.arange(_TABLE) + 0.5))])
_LOG_FACT = np.concatenate([[0.0, 0.0], np.cumsum(np.log(np.arange(1, _TABLE) + 1.0))])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series; its error is below 1e-15 from x = 4096 on."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of that many zeros and ones."""

    def half(n: np.ndarray) -> np.ndarray:
        return np.where(n < _TABLE, _LOG_HALF[np.minimum(n, _TABLE - 1)], _log_gamma(np.maximum(n, _TABLE - 1) + 0.5))

    def fact(n: np.ndarray) -> np.ndarray:
        return np.where(n < _TABLE, _LOG_FACT[np.minimum(n, _TABLE - 1)], _log_gamma(np.maximum(n, _TABLE - 1) + 1.0))

    return half(zeros) + half(ones) - np.log(np.pi) - fact(zeros + ones)


class Levels:
    """The trees over one set of grams, from depth `depth` up to depth `top`; the set holds all grams of each context of
    `top` bytes that it has any of. keys: distinct grams, sorted. counts: how often training saw each, 0 allowed."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
        self.depth, self.top = depth, top
        symbol, context = keys & np.uint64(255), keys >> np.uint64(8)
        at, ones_at = [], []
        for k in range(8):
            at.append((context << np.uint64(8)) | np.uint64(1 << k) | (symbol >> np.uint64(8 - k)))
            ones_at.append(((symbol >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64))
        self.bits = np.stack(ones_at)
        nodes, place = np.unique(np.concatenate(at), return_inverse=True)
        ones = np.bincount(place, np.tile(counts, 8) * self.bits.ravel(), len(nodes)).astype(np.int64)
        zeros = np.bincount(place, np.tile(counts, 8) * (1 - self.bits.ravel()), len(nodes)).astype(np.int64)
        self.place = place.reshape(8, -1)  # of a gram's decision among the deepest nodes
        self.nodes, self.zeros, self.ones, self.up = [nodes], [zeros], [ones], []
        for _ in range(depth - top):  # shed the oldest byte of the context
            above, to = np.unique(((self.nodes[-1] >> np.uint64(16)) << np.uint64(8)) | (self.nodes[-1] & np.uint64(255)), return_inverse=True)
            self.up.append(to)
            self.zeros.append(np.bincount(to, self.zeros[-1], len(above)).astype(np.int64))
            self.ones.append(np.bincount(to, self.ones[-1], len(above)).astype(np.int64))
            self.nodes.append(above)
        self.log_own = [log_kt(z, o) for z, o in zip(self.zeros, self.ones, strict=True)]
        self.log_weighted = [self.log_own[0]]
        for i, to in enumerate(self.up):
            below = np.bincount(to, self.log_weighted[i], len(self.nodes[i + 1]))
            self.log_weighted.append(np.logaddexp(self.log_own[i + 1], below) - np.log(2))

    def mixed(self) -> tuple[np.ndarray, np.ndarray]:
        """For each decision of each gram, the probability of the bit that follows as the nodes from depth `top` down
        mix it, and whether training saw the node at depth `top` at all. A node that training never saw leaves the
        decision to the nearest one above that it did see."""
        at, p, seen = self.place, np.full(self.bits.shape, 0.5), np.zeros(self.bits.shape, bool)
        for i in range(len(self.nodes)):
            zeros, ones = self.zeros[i][at], self.ones[i][at]
            own = (np.where(self.bits == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)
            stay = np.exp(self.log_own[i] - np.log(2) - self.log_weighted[i])[at] if i else np.ones(at.shape)
            p = np.where(seen, stay * own + (1 - stay) * p, own)
            seen = zeros + ones > 0
            if i < len(self.up):
                at = self.up[i][at]
        return p, seen


def grams(body: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of each text and of its end, in order, and the n+1 offsets of each text's grams. body: the texts' bytes
    one after another; sizes: how many each has. depth: 7 at most."""
    k = np.arange(1, len(sizes) + 1)
    raw = np.full(len(body) + len(sizes) * (depth + 1) + 8, EDGE, np.uint8)
    raw[np.arange(8, len(body) + 8) + np.repeat(k * depth + k - 1, sizes)] = body
    starts = np.cumsum(np.concatenate([[8], sizes[:-1] + depth + 1])) + depth if len(sizes) else np.zeros(0, np.int64)
    off = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64)
    at = np.arange(off[-1]) + np.repeat(starts - off[:-1], sizes + 1)
    # Backwards, the context of a place is the bytes that follow it: one unaligned load has them, most recent first.
    back = raw[::-1].copy()
    loads = np.ndarray((len(back) - 7,), ">u8", back, strides=(1,))
    context = loads[len(raw) - at].astype(np.uint64) >> np.uint64(8 * (8 - depth))
    return (context << np.uint64(8)) | raw[at], off
