"""Tokenizers applied to words, so that a repeated word costs a look-up."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from barloom.llm.textkit import Slice, ranges, slices, span_hash

SLICE = 1 << 22
CACHE_BITS = 22

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: ASCII that is no letter, no white space and no apostrophe.
_OTHER = np.zeros(256, bool)
_OTHER[33:127] = True
_OTHER[_LETTER] = False
_OTHER[ord("'")] = False


class WordCache:
    """A direct-mapped cache from word hashes to numbers of at least zero.

    A word whose slot another one holds is computed again; memory is fixed.
    """

    def __init__(self, bits: int = CACHE_BITS) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.checks = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    def get(self, hashes: np.ndarray, checks: np.ndarray, compute: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The number of each word, told apart by both hashes (128 bits);
        ``compute`` gets places of unknown words."""
        slot = (hashes & self.mask).astype(np.int64)
        value = self.values[slot]
        miss = np.flatnonzero((self.keys[slot] != hashes) | (self.checks[slot] != checks) | (value < 0))
        if len(miss):
            order = miss[np.lexsort((checks[miss], hashes[miss]))]
            key, check = hashes[order], checks[order]
            new = np.ones(len(order), bool)
            new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
            found = compute(order[new]).astype(np.int32)
            value[order] = found[np.cumsum(new) - 1]
            at = (key[new] & self.mask).astype(np.int64)
            self.keys[at], self.checks[at], self.values[at] = key[new], check[new], found
        return value

    def clear(self) -> None:
        self.values[:] = -1


def units(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and starts and ends of parts of words.

    Words are cut between an ASCII letter and other ASCII (apostrophes stay
    with what is beside them).  Words with ``<`` stay whole and keep their case,
    since special tokens may be in them.
    """
    data = part.lower()
    letter, other = _LETTER[data], _OTHER[data]
    cut = np.flatnonzero((letter[:-1] & other[1:]) | (other[:-1] & letter[1:])) + 1
    special = np.unique(np.searchsorted(part.starts, np.flatnonzero(data == ord("<")), "right") - 1)
    owner = np.searchsorted(part.starts, cut, "right") - 1
    ok = (owner >= 0) & (cut < part.ends[owner]) & (cut > part.starts[owner]) if len(part.starts) else np.zeros(len(cut), bool)
    if len(special):
        ok &= ~np.isin(owner, special)
        whole = ranges(part.starts[special], part.ends[special] - part.starts[special])
        data[whole] = part.data[whole]
    cut = cut[ok]
    starts, ends = np.concatenate([part.starts, cut]), np.concatenate([part.ends, cut])
    starts.sort()
    ends.sort()
    return data, starts, ends


class WordEncoder:
    """Token ids of texts under a lower-casing ``tokenizers`` file whose tokens
    never span white space, nor an ASCII letter and other ASCII but apostrophes
    (so parts of words encode one by one)."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache = WordCache()
        self._clear()

    def _clear(self) -> None:
        self.cache.clear()
        self.ids = np.zeros(0, np.uint32)
        self.begin = np.zeros(1, np.int64)  # of each known unit its first id; one more at the end

    def _learn(self, data: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
        words = [data[a:z].decode() for a, z in zip(starts, ends)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        base = len(self.begin) - 1
        self.ids = np.concatenate([self.ids, np.array([x for e in found for x in e], np.uint32)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(e) for e in found], dtype=np.int64)])
        return np.arange(base, base + len(found))

    def texts(self, texts: pa.Array, end_id: int | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Slices ``lo, hi, ids, counts`` of the texts."""
        for lo, hi, part in slices(texts, SLICE):
            if len(self.begin) > 3 << 20:
                self._clear()
            data, starts, ends = units(part)
            raw = data.tobytes()
            lanes = (span_hash(data, starts, ends, lane) for lane in range(2))
            row = self.cache.get(*lanes, lambda i: self._learn(raw, starts[i].tolist(), ends[i].tolist()))
            size = self.begin[row + 1] - self.begin[row]
            flat = self.ids[ranges(self.begin[row], size)]
            total = np.concatenate([[0], np.cumsum(size)])
            edge = total[np.searchsorted(starts, part.offsets)]
            counts = np.diff(edge)
            if end_id is not None:
                flat = np.insert(flat, edge[1:], end_id)
                counts = counts + 1
            yield lo, hi, flat, counts


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One for each worker process, which tasks share one after the other."""
    return WordEncoder(path)
