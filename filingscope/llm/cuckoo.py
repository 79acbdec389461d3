"""A cuckoo filter over 128-bit keys in one NumPy table: bulk insertion, deletion and lookup."""

from __future__ import annotations

import numpy as np

from filingscope.llm.words import mix

SLOTS, LOAD, ROUNDS = 4, 0.85, 500


def _prints(k2: np.ndarray) -> np.ndarray:
    p = (k2 & np.uint64(0xFFFF)).astype(np.uint16)
    return np.where(p == 0, np.uint16(1), p)


class Cuckoo:
    """Buckets of four 16-bit fingerprints; a key lies in one of two buckets, so that it can be taken out again."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells = cells

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(3, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.cells.tobytes()

    def _homes(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = _prints(k2)
        home = (k1 & np.uint64(len(self.cells) - 1)).astype(np.int64)
        return prints, home, self._other(home, prints)

    def _other(self, home: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return home ^ (mix(prints.astype(np.uint64)) & np.uint64(len(self.cells) - 1)).astype(np.int64)

    def has(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        prints, home, other = self._homes(k1, k2)
        return ((self.cells[home] == prints[:, None]) | (self.cells[other] == prints[:, None])).any(1)

    def _place(self, prints: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Fill free slots; True for those that found none."""
        order = np.argsort(home, kind="stable")
        sorted_home = home[order]
        first = np.searchsorted(sorted_home, sorted_home)
        rank = np.arange(len(order)) - first
        free = np.argsort(self.cells[sorted_home] != 0, axis=1, kind="stable")
        room = (self.cells[sorted_home] == 0).sum(1)
        fits = rank < room
        at = order[fits]
        self.cells[home[at], free[fits, rank[fits]]] = prints[at]
        left = np.ones(len(home), bool)
        left[at] = False
        return left

    def add(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """Insert distinct keys; False if the table is too full, in which case a larger one must be built."""
        prints, home, other = self._homes(k1, k2)
        left = self._place(prints, home)
        prints, home = prints[left], other[left]
        for turn in range(ROUNDS):
            if not len(prints):
                return True
            left = self._place(prints, home)
            prints, home = prints[left], home[left]
            _, one = np.unique(home, return_index=True)  # one eviction a bucket
            slot = (mix(prints[one].astype(np.uint64) + np.uint64(turn)) % np.uint64(SLOTS)).astype(np.int64)
            out = self.cells[home[one], slot].copy()
            self.cells[home[one], slot] = prints[one]
            prints[one] = out
            home[one] = self._other(home[one], out)
        return not len(prints)

    def discard(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Take out keys that were inserted."""
        for p, *homes in zip(*(x.tolist() for x in self._homes(k1, k2))):
            for h in homes:
                found = np.flatnonzero(self.cells[h] == p)
                if len(found):
                    self.cells[h, found[0]] = 0
                    break
