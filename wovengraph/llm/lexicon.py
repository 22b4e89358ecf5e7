"""A worker's store of encoded words, keyed by 64-bit hash, held in flat arrays."""

from __future__ import annotations

import numpy as np


class Lexicon:
    """Maps keys to runs of integers.  Past `limit` keys it starts afresh."""

    def __init__(self, limit: int = 500_000) -> None:
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.values = np.zeros(0, np.int32)

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Which of `keys` aren't there."""
        if not len(self.keys):
            return np.ones(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] != keys

    def add(self, keys: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> None:
        """New distinct keys, and their runs one after another."""
        first = len(self.values) + np.cumsum(sizes) - sizes
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.first = np.concatenate([self.first, first])[order]
        self.size = np.concatenate([self.size, sizes])[order]
        self.values = np.concatenate([self.values, values.astype(np.int32)])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, size) of keys that are there."""
        at = np.searchsorted(self.keys, keys)
        return self.first[at], self.size[at]


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices first[k], first[k] + 1, ... of all runs, one after another."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
