"""The binary (23, 12) Golay code as a fuzzy hash of 23-bit words.

Every 23-bit word lies within three bits of exactly one of 4,096 codewords, whose index
is its key.  Two words that differ in one bit either share that key or each has the
other's among the keys of its one-bit neighbours, of which there are at most six."""

from __future__ import annotations

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_GENERATOR = 0b101011100011
_table: list[np.ndarray] = []


def decoder() -> np.ndarray:
    """Codeword index of each 23-bit word; made once a process."""
    if not _table:
        words = np.zeros(4096, np.int32)
        for bit in range(12):
            words[(np.arange(4096) >> bit) & 1 == 1] ^= _GENERATOR << bit
        bits = [1 << i for i in range(23)]
        errors = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
        table = np.full(1 << 23, -1, np.int16)
        for e in errors:
            table[words ^ e] = np.arange(4096)
        _table.append(table)
    return _table[0]


def keys(words: np.ndarray, width: int) -> np.ndarray:
    """Rows of keys: first the word's own, then those of its one-bit neighbours within
    `width` bits that differ from all before, ended by -1."""
    table = decoder()
    own = table[words]
    near = np.stack([own] + [table[words ^ (1 << i)] for i in range(width)], axis=1)
    near.sort(axis=1)
    fresh = np.ones(near.shape, bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    fresh &= near != own[:, None]
    most = int(fresh.sum(1).max(initial=0))
    out = np.full((len(words), most + 1), -1, np.int16)
    out[:, 0] = own
    rows, cols = np.nonzero(fresh)
    out[rows, 1 + (np.cumsum(fresh, axis=1) - 1)[rows, cols]] = near[rows, cols]
    return out
