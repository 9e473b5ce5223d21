"""Words, lines and their hashes of many texts at once, in numpy.

Texts lie one after the other in one byte array.  A word is a run of bytes
other than ``20`` and ``09-0D`` (hex); that equals ``[^\\x20\\x09-\\x0D]+`` on code
points since UTF-8 uses those bytes for those characters alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
SLICE_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 512
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all 64 bits."""
    h = h ^ (h >> U64(31))
    h *= U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of spans of bytes by their contents; lanes differ in every step.

    Eight bytes at a time are taken in and mixed, so no arrangement of parts
    cancels out; spans over ``LONG_SPAN`` bytes are hashed by xxHash.
    """
    size = ends - starts
    out = mix(size.astype(U64) + U64(_ODD[lane]))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at, left, h = starts[live], size[live], out[live]
    while len(live):
        h = mix((h ^ (words[at] & _LOW_BYTES[np.minimum(left, 8)])) + U64(_ODD[lane]))
        over = left <= 8
        out[live[over]] = h[over]
        more = ~over
        live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), _ODD[lane])
    return out


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i..i+k-1 for each i, from hashes of 1, 2, 4, ... words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, at, size, level = None, 0, 1, words
    while True:
        if k & size:
            piece = level[at : at + n]
            out = piece if out is None else mix(out * U64(_ODD[0]) + piece)
            at += size
        if 2 * size > k:
            return mix(out + U64(k))
        level = mix(level[:-size] * U64(_ODD[1]) + level[size:])
        size *= 2


@dataclass
class Slice:
    """Some texts: their bytes, where each starts, and their words."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # of each text, the index of its first word; one more at the end

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lane: int = 0) -> np.ndarray:
        return span_hash(self.data, self.starts, self.ends, lane)

    def lower(self) -> np.ndarray:
        return _LOWER[self.data]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum over each text of a flag per byte."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of all lines; a text without bytes has one."""
        breaks = np.flatnonzero(self.data == 10)
        owner = np.searchsorted(self.offsets[1:], breaks, "right")
        doc = np.concatenate([np.arange(self.n), owner])
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        ends = np.concatenate([self.offsets[1:], breaks])
        order = np.lexsort((starts, doc))
        doc, starts = doc[order], starts[order]
        ends = ends[np.lexsort((ends, np.concatenate([np.arange(self.n), owner])))]
        return starts, ends, doc


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words."""
    n = len(data)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
    return starts, ends


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES, most: int = 1 << 30) -> Iterator[tuple[int, int, Slice]]:
    """The texts in slices of at most ``limit`` bytes (one text at least) and
    ``most`` texts."""
    data, offsets = raw(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, min(lo + most, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends = spans(part, offs)
        first = np.searchsorted(starts, offs)
        yield lo, hi, Slice(part, offs, starts, ends, np.repeat(np.arange(hi - lo), np.diff(first)), first)
        lo = hi


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each start and length, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - skip, lengths)
