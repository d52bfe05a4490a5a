"""A minimal perfect hash of 64-bit keys as numpy arrays, with the keys stored by slot."""

from __future__ import annotations

import numpy as np

from lotwise.llm import textnp as T

_STEP = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """Slots 0 to n - 1 for n keys.

    Each level has about two bits for each key that no level above has placed: a key's bit is set if no other key falls on it, the rest goes one level down. A slot is the number of set bits
    before the key's own, from a running count for each 64 bits. The key stored at the slot tells members from all other numbers.
    """

    def __init__(self, keys: np.ndarray):
        keys = left = np.unique(keys.astype(np.uint64))
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        before = 0
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            at = self._at(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view("<u8")
            ranks = before + np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
            self.levels.append((size, bits, ranks[:-1]))
            left, before = left[~alone[at]], int(ranks[-1])
        self.keys = np.zeros(len(keys), np.uint64)
        self.keys[self._slots(keys)] = keys

    def __len__(self) -> int:
        return len(self.keys)

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (T.mix(keys + np.uint64((level + 1) * int(_STEP) % 2**64)) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, bits, ranks) in enumerate(self.levels):
            at = self._at(keys[todo], level, size)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            there = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[there]] = (ranks[at >> 6] + below)[there]
            todo = todo[~there]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slots of the keys; -1 for those that are no members."""
        slots = self._slots(keys)
        if len(self):
            slots[self.keys[slots] != keys] = -1
        return slots
