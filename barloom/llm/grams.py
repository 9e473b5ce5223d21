"""Hash buckets of words and of short strings, for the classifiers."""

from __future__ import annotations

import numpy as np

from barloom.llm.textkit import Slice

_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def char_buckets(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of each run of n bytes or code points, by where it starts."""
    size = max(0, len(data) - n + 1)
    h = np.zeros(size, np.uint32)
    for j in range(n):
        h += data[j : j + size].astype(np.uint32) * _ODD[j]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - bits)).astype(np.int32)


def word_buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int32)


def owner_of_bytes(part: Slice) -> np.ndarray:
    return np.repeat(np.arange(part.n, dtype=np.int32), np.diff(part.offsets))


def histogram(owner: np.ndarray, bucket: np.ndarray, texts: int, bits: int) -> np.ndarray:
    """Counts of each bucket (columns) in each text (rows)."""
    return np.bincount((owner.astype(np.int64) << bits) + bucket, minlength=texts << bits).reshape(texts, 1 << bits)
