"""Periodic runs of words, found on a harmonic grid.

A run is a maximal stretch of words that repeats with its smallest period.  For
each period p the grid has points at multiples of p; a run of period p that is
long enough covers a grid point jp together with (j+1)p, wherever it lies.  There
the longest common extension (LCE) of the two places, forward and backward, gives
both ends of the run.  An LCE is a minimum over a stretch of the LCP array between
two suffixes: suffix array, LCP and range minima are built for the words and for
the words in reverse.  Runs must reach ``max(least, 3p)`` words, so of the grid of p
every g-th point is enough, where g*p <= max(least, 3p) - p.

A pair of grid points whose words don't agree over a stretch that such a run
would force beside them needs no query, and texts without a pair left need no
suffix array.  Several texts share one array; their suffixes are ranked by text
first, so that nothing extends into another text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.textkit import Slice, ranges, slices

#: Words of the shortest run.
LEAST = 24
#: Grid pairs that are looked at in one go.
PAIRS = 1 << 20
#: Ranks in a block of the range minima.
BLOCK = 32


def suffix_array(key: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of the texts in ``key`` (small numbers, ascending from
    text to text), where ``end[i]`` is the end of the text that holds i.

    Prefix doubling: each round sorts only suffixes that still share their rank.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    first = _firsts(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = first
    size = np.diff(np.append(np.flatnonzero(first == np.arange(n)), n))
    active, h = order[np.repeat(size, size) > 1], 1
    while len(active):
        ahead = active + h
        second = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[active]))
        a, second = active[order], second[order]
        group = rank[a]
        begin = _firsts(group)
        first = _firsts(second, group)
        rank[a] = group + first - begin
        starts = np.flatnonzero(first == np.arange(len(a)))
        size = np.diff(np.append(starts, len(a)))
        active = a[np.repeat(size, size) > 1]
        h *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa, rank


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """For each row of sorted columns, where the first row alike is."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)


def common_prefixes(words: np.ndarray, end: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each rank r > 0, the words that suffixes sa[r-1] and sa[r] share.

    Where the words before the two agree, a place has one word less in common
    than the place before it; only the other places are compared, and those
    comparisons sum to n log n words at most.
    """
    n = len(words)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    other = np.maximum(before, 0)
    same = (before >= 0) & (end[other] == end)
    reducible = same & (at > 0) & (other > 0)
    reducible &= (end[np.maximum(at - 1, 0)] == end) & (end[np.maximum(other - 1, 0)] == end)
    reducible &= words[np.maximum(at - 1, 0)] == words[np.maximum(other - 1, 0)]
    shared = np.zeros(n, np.int64)
    left = np.flatnonzero(same & ~reducible)
    done, width = np.zeros(len(left), np.int64), 8
    while len(left):
        for lo in range(0, len(left), max(1, (1 << 22) // width)):
            part = slice(lo, lo + max(1, (1 << 22) // width))
            x = left[part, None] + done[part, None] + np.arange(width)
            y = before[left[part], None] + done[part, None] + np.arange(width)
            stop = end[left[part], None]
            equal = (x < stop) & (y < stop)
            equal &= words[np.minimum(x, n - 1)] == words[np.minimum(y, n - 1)]
            done[part] += np.where(equal.all(axis=1), width, equal.argmin(axis=1))
            more = equal.all(axis=1)
            shared[left[part]] = done[part]
            left[part] = np.where(more, left[part], -1)
        keep = left >= 0
        left, done, width = left[keep], done[keep], min(width * 2, 1 << 16)
    known = np.where(same & ~reducible, shared + at, 0)
    shared = np.where(reducible, np.maximum(np.maximum.accumulate(known) - at, 0), shared)
    return shared[sa]


class Extensions:
    """LCE queries: suffix array, LCP, and minima of blocks of the LCP array (a
    sparse table over blocks, running minima inside them; linear memory)."""

    def __init__(self, words: np.ndarray, text: np.ndarray, end: np.ndarray) -> None:
        self.end = end
        sa, self.rank = suffix_array(text * (int(words.max(initial=0)) + 1) + words, end)
        lcp = common_prefixes(words, end, sa, self.rank)
        blocks = -(-len(lcp) // BLOCK)
        full = np.full((blocks, BLOCK), np.iinfo(np.int64).max)
        full.ravel()[: len(lcp)] = lcp
        self.lcp = full.ravel()
        self.up = np.minimum.accumulate(full, axis=1).ravel()
        self.down = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [full.min(axis=1)]
        while 2 << (len(self.levels) - 1) <= blocks:
            low, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j (of one text, i != j; past the end: none) share."""
        inside = (i < len(self.end)) & (j < len(self.end))
        a, b = self.rank[np.where(inside, i, 0)], self.rank[np.where(inside, j, 0)]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b)
        first, last = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.down[np.minimum(lo, len(self.down) - 1)], self.up[hi])
        wide = np.flatnonzero(last - first > 1)
        if len(wide):
            x, y = first[wide] + 1, last[wide]
            level = np.frexp(y - x)[1] - 1
            for k in np.unique(level).tolist():
                of = level == k
                low = np.minimum(self.levels[k][x[of]], self.levels[k][y[of] - (1 << k)])
                out[wide[of]] = np.minimum(out[wide[of]], low)
        near = np.flatnonzero(first == last)
        for c in range(0, len(near), 1 << 16):
            some = near[c : c + (1 << 16)]
            place = lo[some, None] + np.arange(BLOCK)
            values = self.lcp[np.minimum(place, len(self.lcp) - 1)]
            out[some] = np.where(place <= hi[some, None], values, np.iinfo(np.int64).max).min(axis=1)
        return np.where(inside, out, 0)


def _grid(n: np.ndarray, base: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i (a multiple of p in its text, given by where it starts) and periods p,
    in portions, of all pairs of grid points."""
    fits = np.flatnonzero(n >= max(least, 3))
    longest = n[fits] // 3
    text = np.repeat(fits, longest)
    p = ranges(np.ones(len(fits), np.int64), longest)
    step = np.maximum((np.maximum(least, 3 * p) - p) // p, 1) * p
    count = (n[text] - p - 1) // step + 1
    portion = np.cumsum(count) // PAIRS
    cuts = np.append(np.flatnonzero(np.append(True, portion[1:] != portion[:-1])), len(p)) if len(p) else np.zeros(0, np.int64)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        c = count[lo:hi]
        turn = ranges(np.zeros(len(c), np.int64), c)
        yield np.repeat(base[text[lo:hi]], c) + turn * np.repeat(step[lo:hi], c), np.repeat(p[lo:hi], c)


def _worth_a_query(words: np.ndarray, text: np.ndarray, i: np.ndarray, p: np.ndarray, least: int) -> np.ndarray:
    """The pairs whose words agree at i, and at some places to one side of it, over
    half of the shortest matching stretch (``max(least, 3p) - p`` places)."""
    last = len(words) - 1

    def agree(at: np.ndarray, some: np.ndarray) -> np.ndarray:
        far = at + p[some]
        ok = (at >= 0) & (far <= last)
        at, far = np.clip(at, 0, last), np.clip(far, 0, last)
        return ok & (words[at] == words[far]) & (text[at] == text[i[some]]) & (text[far] == text[i[some]])

    left = np.flatnonzero(agree(i, np.arange(len(i))))
    half = (np.maximum(least, 3 * p) - p - 1) // 2
    for share in (8, 4, 2, 1):
        if len(left):
            step = np.maximum(half[left] // share, 1) if least > 3 else np.zeros(len(left), np.int64)
            left = left[agree(i[left] + step, left) | agree(i[left] - step, left)]
    return left


def find_runs(words: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of texts whose words are ``words[first[t]:first[t + 1]]``: text, start
    (in the text), length and smallest period, by text, start and period."""
    n, base = np.diff(first), first[:-1]
    text = np.repeat(np.arange(len(n)), n)
    hit = np.zeros(len(n), bool)
    for i, p in _grid(n, base, least):
        hit[text[i[_worth_a_query(words, text, i, p, least)]]] = True
    # only texts with a pair left, closed up, and their words numbered from zero
    used = np.flatnonzero(hit)
    if not len(used):
        return (np.zeros(0, np.int64),) * 4
    n = n[used]
    small = np.unique(words[ranges(base[used], n)], return_inverse=True)[1].astype(np.int64)
    moved = np.cumsum(n) - n
    owner, total = np.repeat(np.arange(len(used)), n), len(small)
    forward = Extensions(small, owner, (moved + n)[owner])
    back = Extensions(small[::-1], owner[-1] - owner[::-1], total - moved[owner][::-1])
    found = []
    for x, q in _grid(n, moved, least):
        left = _worth_a_query(small, owner, x, q, least)
        x, q = x[left], q[left]
        # in the reversed array place k is total - 1 - k; places before the text's first word have none
        behind = np.where(x > moved[owner[x]], back(total - x, total - x - q), 0)
        length = q + forward(x, x + q) + behind
        long = length >= np.maximum(least, 3 * q)
        x, q, length, behind = x[long], q[long], length[long], behind[long]
        order = np.lexsort((q, length, x - behind))
        start, q, length = (x - behind)[order], q[order], length[order]
        new = _firsts(start, length) == np.arange(len(start))
        found.append((start[new], q[new], length[new]))
    start, q, length = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((q, length, start))
    start, q, length = start[order], q[order], length[order]
    new = _firsts(start, length) == np.arange(len(start))  # of equal stretches the smallest period
    start, q, length = start[new], q[new], length[new]
    order = np.lexsort((q, start))
    start, q, length = start[order], q[order], length[order]
    of = owner[start] if len(start) else np.zeros(0, np.int64)
    return used[of], start - moved[of], length, q


def word_numbers(part: Slice) -> np.ndarray:
    """A number for each word, equal just where the words are (128 bits of hash)."""
    a, b = part.hashes(), part.hashes(1)
    order = np.lexsort((b, a))
    out = np.empty(len(a), np.int64)
    out[order] = _firsts(a[order], b[order])
    return out


def _best(length: list[int], period: list[int]) -> int:
    """The run with the greatest length/period, exactly; the first one of equals."""
    best = 0
    for k in range(1, len(length)):
        if length[k] * period[best] > length[best] * period[k]:
            best = k
    return best


def _collapsed(part: Slice, kept: np.ndarray) -> list[str]:
    """The kept words of each text, joined by one space."""
    left = np.flatnonzero(kept)
    size = part.ends[left] - part.starts[left] + 1
    ends = np.cumsum(size)
    out = np.full(int(size.sum()), 32, np.uint8)
    solid = np.ones(len(out), bool)
    solid[ends - 1] = False
    out[solid] = part.data[ranges(part.starts[left], size - 1)]
    edge = np.concatenate([[0], ends])[np.searchsorted(left, part.first)]
    data = out.tobytes()
    return [data[a : max(a, z - 1)].decode() for a, z in zip(edge[:-1].tolist(), edge[1:].tolist())]


RUN = "struct<start: long, length: long, period: long>"


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, n_words, runs, best, collapsed`` of whole texts.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  ``runs`` has every run (``start,
    length, period``) of ``max(least, 3 * period)`` words or more, by start, then period;
    ``best`` the one with the greatest length/period (of equals the first), or null.
    ``collapsed`` is the text without words that lie in a run past its first period,
    joined by one space.  Null and empty texts have no words and no runs and collapse
    to an empty text; rows without a doc_id and repeated rows are treated like others;
    other columns are left out; an empty table gives no rows.  Memory follows a slice
    of 2 MB or the longest single text.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, part in slices(b.column(1)):
                text, start, length, period = find_runs(word_numbers(part), part.first, least)
                cut = np.searchsorted(text, np.arange(part.n + 1))
                edge = np.zeros(len(part.starts) + 1, np.int64)
                begin = part.first[text] + start
                np.add.at(edge, begin + period, 1)
                np.add.at(edge, begin + length, -1)
                kept = np.cumsum(edge[:-1]) == 0
                columns = [pa.array(c.astype(np.int64)) for c in (start, length, period)]
                runs = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.StructArray.from_arrays(columns, ["start", "length", "period"]))
                best = [
                    None if a == z else a + _best(length[a:z].tolist(), period[a:z].tolist()) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())
                ]
                best = pa.StructArray.from_arrays(
                    [c.take(pa.array(best, pa.int64())) for c in columns], ["start", "length", "period"],
                    mask=pa.array([k is None for k in best], pa.bool_())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo), pa.array(part.counts.astype(np.int64)), runs, best,
                        pa.array(_collapsed(part, kept), pa.string())
                    ],
                    names=["doc_id", "n_words", "runs", "best", "collapsed"]
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        job, f"doc_id long, n_words long, runs array<{RUN}>, best {RUN}, collapsed string"
    )
