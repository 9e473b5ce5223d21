"""Near duplicates by the similarity of their texts, found through SimHash.

Two texts are near duplicates where the sets of their five-word shingles have
a Jaccard similarity of 0.8 or more.  Candidates come from SimHash sketches of
256 bits: a view is a random choice of bits, and sketches that agree in one
view and differ in at most ``RADIUS`` bits are candidates.  At similarity 0.8 a
bit agrees with probability 0.8485 (angle acos(8/9)); there are as many views as
a pair of that similarity needs to meet in five on average.  Inside a key the
table of distances to a few of its own sketches (pivots) discards pairs that the
triangle inequality rules out, and Hamming distance verifies the rest.  Each
candidate is checked on the whole sets.

Two rounds keep dense and crowded keys cheap.  The first compares keys block by
block; where most pairs of a block are candidates, it checks each sketch with its
nearest one and with the one that is near to most.  The second takes up all dense
keys and all keys of several blocks again with sketches of 1024 bits: every block
meets every other one, but for blocks of the key's largest component, whose pairs
are decided; candidates whose ends are still in different components are checked,
once.  Keys of very many blocks are first split by views of the longer sketch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from math import acos, ceil, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import written
from barloom.llm.components import components
from barloom.llm.textkit import gram_hash, mix, slices

U64 = np.uint64
SHINGLE, WORDS = 5, 4
#: Candidates differ in at most so many of the 256 bits (0.8: 39, deviation 6).
RADIUS = 58
#: Sketches so near count as neighbours of a centre (0.77: 43 bits).
CLOSE = 44
AGREE = 1 - acos(8 / 9) / pi
#: Sketches that are compared in one group; keys with more are dealt in blocks.
BLOCK = 1024
#: A group with more candidates than this for each sketch is dense.
DENSE = 3
#: Words of the second round's sketches, and their radius (0.8: 155, deviation 11.5).
LONG, LONG_RADIUS = 16, 186
#: Keys of more blocks are split by views of the long sketch.
MANY = 64
#: Pivots of a group's distance table.
PIVOTS = 8
#: Pairs that are compared at a time (a single group may have more).
PAIRS = 1 << 18
BITS = [f"s{k}" for k in range(WORDS)]
SKETCH = ", ".join(f"{s} long" for s in BITS)
PAIR = "u long, v long, far short"


def _marks(docs: DataFrame, width: int = WORDS, sets: bool = False) -> DataFrame:
    """``doc_id, version, node, s0, s1, ...``: hashes of the text and of its shingle
    set, and a sketch of so many words; with ``sets``, ``doc_id, version, node, grams``:
    the hashes and the set itself."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, part in slices(b.column(1)):
                words = replace(part, data=part.lower()).hashes()
                counts = part.counts
                shingles = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
                owner = np.repeat(np.arange(part.n), shingles)
                first = part.first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
                h = np.zeros(len(owner), U64)
                for k in range(1, SHINGLE + 1):
                    of = np.flatnonzero(np.minimum(counts[owner], SHINGLE) == k)
                    if len(of):
                        h[of] = gram_hash(words, k)[first[of]]
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                h, owner = h[new], owner[new]
                n = np.bincount(owner, minlength=part.n)
                ends = np.cumsum(n)
                begins = ends - n
                node = np.array([xxhash.xxh3_64_intdigest(h[x:y].tobytes()) for x, y in zip(begins.tolist(), ends.tolist())], U64)
                if sets:
                    values = [pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(h.view(np.int64)))]
                else:
                    values = [pa.array(x.view(np.int64)) for x in _sketches(h, n, width)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(node.view(np.int64)), *values],
                    names=["doc_id", "version", "node", *names]
                )

    names = ["grams"] if sets else [f"s{k}" for k in range(width)]
    kinds = "grams array<long>" if sets else ", ".join(f"{s} long" for s in names)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("version", F.xxhash64("text"))
    return rows.mapInArrow(job, f"doc_id long, version long, node long, {kinds}")


def _sketches(h: np.ndarray, n: np.ndarray, words: int) -> list[np.ndarray]:
    """The words of the sketches of sets of ``n`` hashes each, all in ``h``."""
    full = np.flatnonzero(n)
    begins = (np.cumsum(n) - n)[full]
    out = []
    for k in range(words):
        votes, sketch = np.zeros((len(full), 64), np.int64), np.zeros(len(n), U64)
        bits_of = mix(h ^ U64(0x9E3779B97F4A7C15 * (k + 1) % 2**64))
        for a in range(0, len(h), 1 << 16):  # bits of a stretch at a time
            bits = np.unpackbits(bits_of[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, j = np.searchsorted(begins, a, "right") - 1, np.searchsorted(begins, a + len(bits), "left")
            votes[i:j] += np.add.reduceat(bits, np.maximum(begins[i:j] - a, 0), axis=0, dtype=np.int32)
        if len(full):
            sketch[full] = np.packbits(2 * votes > n[full][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        out.append(sketch)
    return out


def _choices(total: int) -> list[np.ndarray]:
    """The bits of each view; keys hold about 64 unlike sketches."""
    wide = min(max(8, ceil(log2(max(total, 1) / 64))), 30)
    rng = np.random.default_rng(12)
    return [rng.choice(64 * WORDS, wide, replace=False) for _ in range(ceil(5 / AGREE**wide))]


def _views(nodes: DataFrame, views: list[np.ndarray]) -> DataFrame:
    """A row for each node and view (the high half of ``key``)."""
    power = 1 << np.arange(len(views[0]), dtype=np.int64)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sketch = np.stack([b.column(s).to_numpy(zero_copy_only=False) for s in BITS], axis=1)
            bits = np.unpackbits(np.ascontiguousarray(sketch).astype("<i8").view(np.uint8), axis=1, bitorder="little")
            for v, at in enumerate(views):
                key = bits[:, at].astype(np.int64) @ power + (v << 32)
                yield pa.RecordBatch.from_arrays([pa.array(key), *b.columns], names=["key", *b.schema.names])

    others = [f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema]
    return nodes.mapInArrow(job, ", ".join(["key long", *others]))


def _runs(batches: Iterator[pa.RecordBatch], work: Callable[..., Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Whole groups (rows alike in the first column, ``g``) of sorted batches, so
    many at a time that they have about ``PAIRS`` pairs."""

    def some(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        begins, size = _groups(columns[0])
        part = np.cumsum(size * size) // PAIRS
        cuts = np.append(begins[np.flatnonzero(np.append(True, part[1:] != part[:-1]))], len(columns[0]))
        for a, z in zip(cuts[:-1], cuts[1:]):
            yield from work(*(x[a:z] for x in columns))

    held = None
    for b in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            new = [np.concatenate([x, y]) for x, y in zip(held, new)]
        cut = int(np.searchsorted(new[0], new[0][-1], "left")) if len(new[0]) else 0
        held = [x[cut:] for x in new]  # the last group may go on in the next batch
        if cut:
            yield from some(*(x[:cut] for x in new))
    if held is not None and len(held[0]):
        yield from some(*held)


def _apart(sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int16)


def _near_pairs(
    sketch: np.ndarray, begins: np.ndarray, size: np.ndarray, apart: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i < j of the same group within the radius, and their distances;
    ``apart`` says which pairs count at all."""
    first, many = np.repeat(begins, size), np.repeat(size, size)
    stop, everyone = first + many, np.arange(len(sketch))
    table = np.stack([_apart(sketch, everyone, first + p * many // PIVOTS) for p in range(PIVOTS)], axis=1)
    us, vs, near = [], [], []
    active = everyone
    for d in range(1, int(size.max())):
        active = active[active + d < stop[active]]
        a = active if apart is None else active[apart(active, active + d)]
        a = a[np.abs(table[a] - table[a + d]).max(axis=1, initial=0) <= RADIUS]
        far = _apart(sketch, a, a + d)
        ok = far <= RADIUS
        us.append(a[ok])
        vs.append(a[ok] + d)
        near.append(far[ok])
    return np.concatenate([*us, everyone[:0]]), np.concatenate([*vs, everyone[:0]]), np.concatenate([*near, np.zeros(0, np.int16)])


def _batch(node: np.ndarray, u: np.ndarray, v: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
    a, b = node[u], node[v]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(far)], names=["u", "v", "far"])


def _groups(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return begins, np.diff(np.append(begins, len(g)))


def _first_round(g, key, node, *sketch) -> Iterator[pa.RecordBatch]:
    """All candidates of a group.  Of a dense one each sketch with its nearest and
    with the one that is close to most, and the key twice, at distance -1, as a mark."""
    begins, size = _groups(g)
    u, v, far = _near_pairs(np.stack(sketch, axis=1).view(U64), begins, size)
    of = np.repeat(np.arange(len(begins)), size)
    dense = np.bincount(of[u], minlength=len(begins)) > DENSE * size
    keep = ~dense[of[u]]
    for k in np.flatnonzero(dense).tolist():
        at = np.flatnonzero(of[u] == k)
        a, b, d = np.concatenate([u[at], v[at]]), np.concatenate([v[at], u[at]]), np.concatenate([far[at], far[at]])
        order = np.lexsort((d, a))
        rank = np.arange(len(a)) - np.searchsorted(a[order], a[order], "left")
        keep[at[order[rank == 0] % len(at)]] = True
        centre = int(np.bincount(a[d <= CLOSE], minlength=1).argmax()) if (d <= CLOSE).any() else int(a[0])
        keep[at[((u[at] == centre) | (v[at] == centre)) & (far[at] <= CLOSE)]] = True
    mark = begins[dense]
    yield _batch(node, u[keep], v[keep], far[keep])
    yield _batch(key, mark, mark, np.full(len(mark), -1, np.int16))


def _met_before(x: np.ndarray, y: np.ndarray, view: np.ndarray, views: list[np.ndarray]) -> np.ndarray:
    """Whether two sketches agree in a view before the one they meet in."""
    out = np.zeros(len(x), bool)
    inside = np.zeros((64 * WORDS, len(views)), np.float32)
    for k, at in enumerate(views):
        inside[at, k] = 1
    for lo in range(0, len(x), 1 << 14):
        bits = np.unpackbits((x[lo : lo + (1 << 14)] ^ y[lo : lo + (1 << 14)]).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        first = (bits.astype(np.float32) @ inside == 0).argmax(axis=1)
        out[lo : lo + (1 << 14)] = first < view[lo : lo + (1 << 14)]
    return out


def _second_round(views: list[np.ndarray]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """Candidates of a group whose components differ, in the first view that they
    share.

    ``side`` is 0 where all pairs of the group count, else 1 or 2, and then
    only pairs of different sides do (the others meet in groups of their own).
    """

    def work(g, side, view, node, comp, *sketch) -> Iterator[pa.RecordBatch]:
        begins, size = _groups(g)
        rows, more = (np.stack(x, axis=1).view(U64) for x in (sketch[:WORDS], sketch[WORDS:]))
        u, v, far = _near_pairs(rows, begins, size, lambda a, b: (comp[a] != comp[b]) & ((side[a] == 0) | (side[a] != side[b])))
        near = np.flatnonzero(
            far + np.concatenate([_apart(more, u[a : a + PAIRS], v[a : a + PAIRS]) for a in range(0, max(len(u), 1), PAIRS)]) <= LONG_RADIUS
        )
        u, v, far = u[near], v[near], far[near]
        new = ~_met_before(rows[u], rows[v], view[u], views)
        yield _batch(node, u[new], v[new], far[new])

    return work


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, grams`` of the nodes ``wanted(node, doc_id)``, a row for each."""
    wanted = written(wanted, "wanted")
    some = docs.where("doc_id is not null").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = _marks(some, sets=True).join(wanted.withColumnRenamed("doc_id", "__doc"), "node").where("doc_id = __doc")
    return written(sets.dropDuplicates(["node"]).select("node", "grams"), "sets")


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``u, v, alike``: whether the whole sets are similar enough."""
    side = lambda n, g: sets.select(F.col("node").alias(n), F.col("grams").alias(g))
    both = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v")
    both = both.withColumn("same", F.size(F.array_intersect("a", "b")))
    return both.select("u", "v", (5 * F.col("same") >= 4 * (F.size("a") + F.size("b") - F.col("same"))).alias("alike"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()


def _split(rows: DataFrame, most: int, block: int) -> DataFrame:
    """Rows of keys with up to ``most`` sketches, once for each of some views of the
    long sketch; ``key`` becomes a hash of the old one and the view's bits."""
    wide = min(max(6, ceil(log2(most / block))), 24)
    rng = np.random.default_rng(21)
    views = [rng.choice(64 * LONG, wide, replace=False) for _ in range(ceil(5 / AGREE**wide))]
    power = 1 << np.arange(wide, dtype=np.int64)
    names = [f"s{k}" for k in range(LONG)]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sketch = np.stack([b.column(s).to_numpy(zero_copy_only=False) for s in names], axis=1)
            bits = np.unpackbits(np.ascontiguousarray(sketch).astype("<i8").view(np.uint8), axis=1, bitorder="little")
            old = mix(b.column("key").to_numpy(zero_copy_only=False).view(U64))
            for v, at in enumerate(views):
                key = mix(old + (bits[:, at].astype(np.int64) @ power + (v << 32)).view(U64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), *b.columns[1:]], names=b.schema.names)

    return rows.select("key", "view", "node", "comp", *names).mapInArrow(
        job, f"key long, view int, node long, comp long, {', '.join(f'{s} long' for s in names)}"
    )


def _shares(rows: DataFrame, block: int) -> DataFrame:
    """For each key with several components: the largest one (``main``), its blocks
    (``mains``) and the blocks of all others (``minors``)."""
    each = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    keys = each.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    up = lambda n: F.ceil(n / block)
    return keys.select("key", F.col("top.comp").alias("main"), up(F.col("top.n")).alias("mains"), up(F.col("n") - F.col("top.n")).alias("minors"))


def _block_pairs(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """``g, side`` and the rows' columns: a group for each two blocks of a key that
    have pairs of different components.  Blocks of the largest component meet
    the others' alone."""
    rows = rows.join(shares, "key").withColumn("is_main", F.expr("comp = main"))
    rows = rows.withColumn("home", F.expr("pmod(xxhash64(node), if(is_main, mains, minors))"))
    to_minors = "transform(sequence(0L, minors - 1), x -> {})"
    main = to_minors.format("struct(1 AS kind, home AS a, x AS b, 1 AS side)")
    own = to_minors.format(
        "struct(0 AS kind, least(home, x) AS a, greatest(home, x) AS b, CASE WHEN home = x THEN 0 WHEN home < x THEN 1 ELSE 2 END AS side)"
    )
    minor = f"concat({own}, transform(sequence(0L, mains - 1), x -> struct(1 AS kind, x AS a, home AS b, 2 AS side)))"
    rows = rows.withColumn("at", F.explode(F.expr(f"if(is_main, {main}, {minor})")))
    return rows.select(
        F.xxhash64("key", "at.kind", "at.a", "at.b").alias("g"), F.col("at.side").alias("side"), "view", "node", "comp",
        *[f"s{k}" for k in range(LONG)]
    )


def _taken_up(
    docs: DataFrame, ids: DataFrame, sketches: DataFrame, keys: DataFrame, edges: DataFrame, choices: list[np.ndarray], block: int
) -> DataFrame:
    """The second round: candidates ``u, v`` of dense and crowded keys whose ends are
    in different components."""
    rows = written(
        sketches.join(components(edges), "node", "left").withColumn("comp", F.coalesce("low", "node")).select("node", "comp", *BITS), "labels"
    )
    met = written(_views(rows, choices).join(keys, "key", "left_semi").select("key", "node", "comp"), "met")
    shares = written(_shares(met, block), "shares")
    met = met.join(shares.select("key"), "key", "left_semi")
    wanted = ids.join(met.select("node").distinct(), "node").select("doc_id").distinct()
    long = _marks(docs.join(wanted, "doc_id", "left_semi"), LONG).drop(*BITS, "doc_id", "version").dropDuplicates(["node"])
    rows = written(rows.drop("comp").join(long, "node"), "long")
    views = met.join(rows, "node").withColumn("view", F.shiftright("key", 32).cast("int"))
    huge = shares.where(F.col("minors") > MANY)
    dealt = _block_pairs(views, shares.where(F.col("minors") <= MANY))
    most = huge.agg(F.max(F.col("minors") + F.col("mains"))).first()[0]
    if most:
        parts = _split(views.join(huge.select("key"), "key", "left_semi").withColumn("view", F.lit(0)), most * block, block)
        parts = written(parts, "split")
        dealt = dealt.unionByName(_block_pairs(parts, _shares(parts, block)))
    dealt = dealt.repartition("g").sortWithinPartitions("g", "node")
    second = _second_round(choices)
    return dealt.mapInArrow(lambda b: _runs(b, second), PAIR).select("u", "v").distinct()


def near_duplicate_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, version, component_id, kept``, a row for each row:
    a hash of its text, the smallest doc_id that the text reaches, and whether
    the row is the one of its group to keep (smallest doc_id, then version).

    A-Z are lower-cased; a text of fewer than five words is one shingle, one
    without words has the empty set, which equals itself alone.  Equal sets are
    one node; rows of one doc_id with several texts are each judged by their text.
    Every candidate is checked unless its ends are in one component already.  A
    key with more than ``block`` sketches is dealt in blocks, so no task holds a
    key, and all its blocks meet.  Rows without a doc_id take no part.
    """
    marks = written(_marks(docs.where("doc_id is not null")), "marks")
    nodes = marks.groupBy("node").agg(*(F.first(s).alias(s) for s in BITS), F.min(F.struct("doc_id", "version")).alias("row"))
    nodes = written(nodes.select("node", "row", F.col("row.doc_id").alias("doc_id"), *BITS), "nodes")
    choices = _choices(nodes.count())
    ids, sketches = nodes.select("node", "doc_id"), nodes.select("node", *BITS)

    views = _views(sketches, choices)
    crowded = written(views.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "crowded")
    blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1))
    dealt = views.join(crowded, "key", "left").select(F.xxhash64("key", F.pmod(F.xxhash64("node"), blocks)).alias("g"), "key", "node", *BITS)
    dealt = dealt.repartition("g").sortWithinPartitions("g", "node")
    found = dealt.mapInArrow(lambda b: _runs(b, _first_round), PAIR)
    pairs = written(found.select("u", "v", (F.col("far") < 0).alias("mark")).distinct(), "pairs")
    keys = written(pairs.where("mark").select(F.col("u").alias("key")).unionByName(crowded.select("key")).distinct(), "keys")
    pairs = pairs.where("not mark").select("u", "v")
    sets = _sets(docs, _ends(pairs).join(ids, "node"))
    tried = written(_checked(pairs, sets), "tried")
    edges = tried.where("alike").select("u", "v")

    if keys.limit(1).count():
        more = _taken_up(docs, ids, sketches, keys, edges, choices, block)
        more = written(more.join(tried, ["u", "v"], "left_anti"), "pairs")
        new = _ends(more).join(sets.select("node"), "node", "left_anti").join(ids, "node")
        checked = _checked(more, sets.unionByName(_sets(docs, new)))
        edges = edges.unionByName(checked.where("alike").select("u", "v"))

    of = nodes.select("node", "row").join(components(edges), "node", "left").withColumn("low", F.coalesce("low", "node"))
    of = written(of, "groups")
    firsts = of.groupBy("low").agg(F.min("row").alias("first"))
    groups = of.join(firsts, "low").select("node", "first")
    kept = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("version") == F.col("first.version"))
    return marks.select("doc_id", "version", "node").join(groups, "node").select(
        "doc_id", "version", F.col("first.doc_id").alias("component_id"), kept.alias("kept")
    )
