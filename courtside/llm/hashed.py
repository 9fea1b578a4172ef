"""Values by 64-bit keys, looked up for many keys at once."""

from __future__ import annotations

import numpy as np

_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


class Table:
    """A few hashed tables, each for the keys whose slots were taken in those before it. Keys are distinct; only keys that
    the table has may be looked up."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        while len(keys):
            bits = max(4, int(len(keys)).bit_length() + 1)
            at = self._slots(keys, len(self.levels), bits)
            owner = np.full(1 << bits, -1, np.int64)
            owner[at] = np.arange(len(keys))
            won = owner[at] == np.arange(len(keys))
            own, value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits)
            spare = np.arange(1, 64, dtype=np.uint64)  # an empty slot holds a key that belongs elsewhere
            zero = self._slots(np.zeros(1, np.uint64), len(self.levels), bits)[0]
            own[zero] = spare[self._slots(spare, len(self.levels), bits) != zero][0]
            own[at[won]], value[at[won]] = keys[won], values[won]
            self.levels.append((bits, own, value))
            keys, values = keys[~won], values[~won]

    @staticmethod
    def _slots(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (keys ^ (keys >> np.uint64(29 + level % 5))) * np.uint64(_ODD[level % len(_ODD)])
            if level >= len(_ODD):
                x = (x ^ (x >> np.uint64(31))) * np.uint64(2 * level + 1)
        return (x >> np.uint64(64 - bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(keys)), None
        for level, (bits, own, value) in enumerate(self.levels):
            slot = self._slots(keys, level, bits)
            hit = own[slot] == keys
            if at is None:
                out, at = np.where(hit, value[slot], 0.0), np.flatnonzero(~hit)
            else:
                out[at[hit]] = value[slot[hit]]
                at = at[~hit]
            if not len(at):
                break
            keys = keys[~hit]
        return out
