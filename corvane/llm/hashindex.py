"""Minimal perfect hash of integer keys, with stored fingerprints, as a few flat arrays.

Level by level every key that is alone in its cell of a bit array is placed there, and the others go to the next level;
the rank of a key's bit is its slot. A look-up tests a few bits and counts ones in one word, so its time is constant.
"""

from __future__ import annotations

import numpy as np

#: Cells of a level for each key that reaches it.
GAMMA = 2.0
FINGERPRINT_SEED = 0xF1

U = np.uint64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing function of integer keys and a seed."""
    x = keys.astype(np.int64).view(np.uint64) + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, FINGERPRINT_SEED) >> U(32)).astype(np.uint32)


def build(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of the index over distinct int64 keys: cells of each level, bits as 64-bit words, ones before each word."""
    rest, cells, words = np.asarray(keys, np.int64), [], []
    while len(rest):
        size = max(64, -(-int(GAMMA * len(rest)) // 64) * 64)
        at = (mix(rest, len(cells)) % U(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        cells.append(size)
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        rest = rest[~alone[at]]
    bits = np.concatenate(words).astype(np.uint64) if words else np.zeros(0, np.uint64)
    ones = np.bitwise_count(bits).astype(np.uint32)
    return {"cells": np.asarray(cells, np.uint64), "bits": bits, "before": np.cumsum(ones, dtype=np.uint32) - ones}


def slots(index: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no level has its bit. A key outside the set may get any slot; fingerprints tell."""
    keys = np.asarray(keys, np.int64)
    found, base = np.full(len(keys), -1, np.int64), 0
    open_ = np.arange(len(keys))
    for level, size in enumerate(int(x) for x in index["cells"]):
        if not len(open_):
            break
        at = (mix(keys[open_], level) % U(size)).astype(np.int64)
        word, bit = base + at // 64, (at % 64).astype(np.uint64)
        value = index["bits"][word]
        here = (value >> bit) & U(1) == 1
        below = np.bitwise_count(value & ((U(1) << bit) - U(1)))
        found[open_[here]] = (index["before"][word].astype(np.int64) + below)[here]
        open_ = open_[~here]
        base += size // 64
    return found
