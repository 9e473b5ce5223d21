"""SimHash fingerprints and their links, found through pivot distance tables.

A pivot is a reference fingerprint.  By the triangle inequality two
fingerprints at Hamming distance at most r have distances to any pivot that
differ by at most r, also where only the bits of one view (a set of bits)
count.  Views are unions of blocks of bits, chosen so that any two
fingerprints at distance ``r`` or less agree in at least one view; there all
their pivot distances are the same, so the table of these distances is a join
key.  Inside a key, pairs whose full-width pivot distances differ by more than
``r`` anywhere are discarded, and the survivors are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import written
from barloom.llm.components import components
from barloom.llm.textkit import mix, slices

U64 = np.uint64
#: Full-width pivots of the discarding step, and pivots of a view.
PIVOTS, VIEW_PIVOTS = 32, 16
#: Blocks that the bits are cut into at each level; a view leaves out r of them.
LEVELS = (6, 12, 24)
#: A key with more fingerprints than this goes on to the next level.
MOST_IN_KEY = 1024


def _fingerprint(texts: pa.Array, shingle: int) -> np.ndarray:
    out = np.zeros(len(texts), U64)
    for lo, hi, part in slices(texts):
        data = part.lower()
        # words joined by one space, so that a shingle is one span of bytes
        lengths = part.ends - part.starts
        new_start = np.cumsum(lengths + 1) - (lengths + 1)
        joined = np.full(int((lengths + 1).sum()), 32, np.uint8)
        keep = np.zeros(len(data) + 1, np.int8)
        np.add.at(keep, part.starts, 1)
        np.add.at(keep, part.ends, -1)
        inside = np.cumsum(keep[:-1]).astype(bool)
        target = np.ones(len(joined), bool)
        target[new_start + lengths] = False
        joined[target] = data[inside]
        new_end = new_start + lengths
        counts = part.counts
        shingles = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
        owner = np.repeat(np.arange(part.n), shingles)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
        first = part.first[owner] + nth
        last = part.first[owner] + nth + np.minimum(counts[owner], shingle) - 1
        buffer, digest = joined.tobytes(), xxhash.xxh64_intdigest
        h = np.fromiter((digest(buffer[a:b], 42) for a, b in zip(new_start[first].tolist(), new_end[last].tolist())), U64, len(owner))
        full = np.flatnonzero(shingles)
        if not len(full):
            continue
        begins = (np.cumsum(shingles) - shingles)[full]
        votes = np.zeros((len(full), 64), np.int64)
        step = 1 << 16
        for a in range(0, len(h), step):  # bits of a stretch of shingles at a time
            bits = np.unpackbits(h[a : a + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, j = np.searchsorted(begins, a, "right") - 1, np.searchsorted(begins, a + len(bits), "left")
            cuts = np.maximum(begins[i:j] - a, 0)
            votes[i:j] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
        on = (2 * votes > shingles[full][:, None]).astype(np.uint8)
        out[lo + full] = np.packbits(on, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, bits`` (the fingerprint as a signed long).

    A-Z are lower-cased; shingles of ``shingle`` words count with repeats; a
    text with fewer words is one shingle; one without words (null, empty) has
    fingerprint zero.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_fingerprint(b.column(1), shingle).view(np.int64))], names=["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(job, "doc_id long, bits long")


def _masks(blocks: int, radius: int) -> np.ndarray:
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    block = [((1 << int(b)) - (1 << int(a))) & (2**64 - 1) for a, b in zip(edges, edges[1:])]
    return np.array([sum(x for i, x in enumerate(block) if i not in out) for out in combinations(range(blocks), radius)], U64)


def _pivots(n: int) -> np.ndarray:
    return np.random.default_rng(8).integers(0, 2**64, n, dtype=np.uint64)


def pivot_table(bits: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Hamming distances of fingerprints (rows) to the first n pivots."""
    return np.bitwise_count(bits[:, None] ^ _pivots(n)[None, :]).astype(np.int16)


def _view_keys(rows: DataFrame, level: int, radius: int) -> DataFrame:
    """A row for each fingerprint and view, keyed by the view's pivot distances."""
    masks, pivots = _masks(LEVELS[level], radius), _pivots(VIEW_PIVOTS)
    weights = np.random.default_rng(9).integers(0, 2**63, VIEW_PIVOTS, dtype=np.uint64) | U64(1)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column(0).to_numpy(zero_copy_only=False).view(U64)
            node = b.column(1).to_numpy(zero_copy_only=False)
            step = max(1, 200_000 // len(masks))
            for a in range(0, len(whole), step):
                bits = whole[a : a + step]
                keys = np.empty((len(bits), len(masks)), U64)
                for k, mask in enumerate(masks):
                    sums = np.full(len(bits), k, U64)
                    for p, w in zip(pivots, weights):
                        sums = sums * U64(0x9E3779B97F4A7C15) + np.bitwise_count((bits ^ p) & mask).astype(U64) * w
                    keys[:, k] = mix(sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(bits, len(masks)).view(np.int64)),
                        pa.array(np.repeat(node[a : a + step], len(masks)))
                    ],
                    names=["key", "bits", "node"],
                )

    return rows.select("bits", "node").mapInArrow(job, "key long, bits long, node long")


def _links_in_keys(members: DataFrame, radius: int) -> DataFrame:
    """Links inside each key, as edges that connect what the links connect.

    A key's fingerprints are compared by offset in one sorted run; of the
    linked pairs only those that join two parts of the key's graph leave.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            new = tuple(c.to_numpy(zero_copy_only=False) for c in b.columns)
            if held is not None:
                new = tuple(np.concatenate([h, x]) for h, x in zip(held, new))
            cut = int(np.searchsorted(new[0], new[0][-1], "left")) if len(new[0]) else 0
            held = tuple(x[cut:] for x in new)  # the last key may go on in the next batch
            if cut:
                yield from _run_links(*(x[:cut] for x in new), radius)
        if held is not None and len(held[0]):
            yield from _run_links(*held, radius)

    ordered = members.repartition("key").sortWithinPartitions("key")
    return ordered.select("key", "bits", "node").mapInArrow(job, "u long, v long")


def _run_links(key: np.ndarray, bits: np.ndarray, node: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    bits = bits.view(U64)
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begins, len(key)))
    run_end = np.repeat(begins + size, size)
    table = pivot_table(bits)
    low = np.arange(len(key))  # the smallest index known to be connected

    def root(i: int) -> int:
        while low[i] != i:
            low[i] = low[low[i]]
            i = low[i]
        return i

    us, vs = [], []
    active = np.arange(len(key))
    for d in range(1, int(size.max())):
        active = active[active + d < run_end[active]]
        a, b = active, active + d
        near = np.abs(table[a] - table[b]).max(axis=1) <= radius
        a, b = a[near], b[near]
        true = np.bitwise_count(bits[a] ^ bits[b]) <= radius
        for i, j in zip(a[true].tolist(), b[true].tolist()):
            x, y = root(i), root(j)
            if x != y:
                low[max(x, y)] = min(x, y)
                us.append(node[i])
                vs.append(node[j])
    if us:
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def simhash_groups(docs: DataFrame, radius: int = 3, shingle: int = 3, most_in_key: int = MOST_IN_KEY) -> DataFrame:
    """Near-duplicate groups: ``doc_id, fingerprint, component_id``.

    Fingerprints link where at most ``radius`` bits differ (tried for radius 3
    or less); ``component_id`` is the smallest doc_id that links reach.  Equal
    fingerprints are one node, however many documents share it.  A key with
    more than ``most_in_key`` fingerprints is taken up by the next level's
    finer views; the last leaves out at most 9 bits, so at most 2**9 fingerprints
    agree in a key's bits (more only where pivot distances coincide), and the answer
    is the same at any size.  Rows with a null doc_id keep a fingerprint and
    belong to no group (null component).  An empty table gives no rows.
    """
    marks = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(marks.where("doc_id is not null").groupBy("bits").agg(F.min("doc_id").alias("node")), "nodes")
    edges, todo = None, nodes
    for level in range(len(LEVELS)):
        rows = written(_view_keys(todo, level, radius), f"views{level}")
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        last = level == len(LEVELS) - 1
        shared = written(rows.join(sizes, "key"), f"shared{level}")
        small = shared if last else shared.where(F.col("n") <= most_in_key)
        found = _links_in_keys(small, radius)
        edges = found if edges is None else edges.unionByName(found)
        if last:
            break
        hot = shared.where(F.col("n") > most_in_key)
        if hot.limit(1).count() == 0:
            break
        todo = written(hot.groupBy("bits").agg(F.min("node").alias("node")), f"hot{level}")
    lows = components(edges)
    named = nodes.join(lows, "node", "left").select("bits", F.coalesce("low", "node").alias("component_id"))
    out = marks.join(named, "bits", "left")
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
