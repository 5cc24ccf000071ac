"""The best few entries of many keys, as arrays that merge."""

from __future__ import annotations

import numpy as np

#: Entries that wait for a merge.
HELD_ROWS = 200_000


def best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` best entries of each row: higher scores first, then smaller ids, then smaller ties."""
    order = np.lexsort((tie, ids, -score, row))
    firsts = np.searchsorted(row[order], row[order], side="left")
    return order[np.arange(len(order)) - firsts < k]


class Heaps:
    """The best `k` (id, score, tie) of each key; what several tiles push is merged at once."""

    def __init__(self, k: int) -> None:
        self._k, self._parts, self._rows, self._kept = k, [], 0, 0

    def push(self, key: np.ndarray, ids: np.ndarray, score: np.ndarray, tie: np.ndarray) -> None:
        self._parts.append((key, ids, score, tie))
        self._rows += len(key)
        if self._rows > 2 * self._kept + HELD_ROWS:
            self.merged()

    def merged(self) -> tuple[np.ndarray, ...]:
        if not self._parts:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        key, ids, score, tie = (np.concatenate(x) for x in zip(*self._parts, strict=True))
        keep = best(key, score, ids, tie, self._k)
        self._parts = [(key[keep], ids[keep], score[keep], tie[keep])]
        self._rows = self._kept = len(keep)
        return self._parts[0]
