from __future__ import annotations

import random
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as h

from barloom.llm.mixing import mix_sources, source_targets, taken_words
from barloom.llm.packing import LENGTHS, best_fit_packing, bin_cost, cheapest, pack

from .cases import SCHEMA, documents


def fill(sizes, weights=(3, 1, 2)):
    """Targets by resharing the excess until none is above."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, total, out = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        share = {s: total * w[s] / sum(w[x] for x in left) for s in left}
        above = [s for s in left if share[s] > 2 * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = 2 * sizes[s]
            total -= out[s]
            left.discard(s)
    return out


def test_targets_and_taken(spark):
    docs, rows = documents(spark)
    got = taken_words(mix_sources(docs, block=16)).collect()
    assert len(got) == len(rows) + 1
    again = taken_words(mix_sources(docs.repartition(7), block=16)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    source = {i: s for i, _, _, s, *_ in rows} | {None: None}
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = fill(sizes)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9)
        assert taken[s] == pytest.approx(want[s], abs=1)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 7}, {"a": 0, "b": 4}, {"a": 3}, {"b": 1, "é": 1, "z": 500, "Z": 40}])
def test_targets_alone(spark, sizes):
    table = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_rows long")
    got = {r.source: r.target for r in source_targets(table, [3, 1, 2], 1.5, 2.0).collect()}
    assert got == pytest.approx(fill(sizes))


def test_schedule_interleaves(spark):
    docs = spark.createDataFrame([(i, "w " * 64, None, "ab"[i % 2], 0, None, None) for i in range(400)], SCHEMA)
    mix = mix_sources(docs)
    slots = [r.sid for r in mix.schedule.orderBy("position").collect()]
    for lo in range(0, len(slots) - 100, 50):
        assert slots[lo : lo + 100].count(0) == pytest.approx(100 * slots.count(0) / len(slots), abs=3)


def test_empty_and_wordless(spark):
    assert taken_words(mix_sources(spark.createDataFrame([], SCHEMA))).count() == 0
    none = spark.createDataFrame([(1, None, None, None, 0, None, None), (1, " ", None, "a", 0, None, None)], SCHEMA)
    assert [(r.size, r.target, r.taken) for r in taken_words(mix_sources(none)).collect()] == [(0, 0.0, 0)] * 2


@given(h.lists(h.integers(1, 900), max_size=120))
def test_bins_hold_their_pieces(lengths):
    lengths = sorted(lengths, reverse=True)
    permitted = (64, 128, 300, 900)
    bins, places, caps = pack(lengths, permitted)
    used: dict[int, list] = {}
    for x, b, p, c in zip(lengths, bins, places, caps):
        used.setdefault(b, []).append((p, x, c))
    for parts in used.values():
        at = 0
        for p, x, c in sorted(parts):
            assert p == at
            at += x
        assert parts[0][2] == min(c for c in permitted if c >= at)


def naive(lengths, permitted):
    """Every open bin and every length looked at, one piece at a time."""
    bins, out = [], []  # a bin: room, used
    for k, x in enumerate(lengths):
        able = [(room, b) for b, (room, _) in enumerate(bins) if room >= x]
        if able:
            room, b = min(able)
        else:
            costs = []
            for cap in (c for c in permitted if c >= x):
                full, rest = x, sorted(lengths[k + 1 :], reverse=True)
                for y in rest:  # the largest that fits, again and again
                    full += y if full + y <= cap else 0
                costs.append((bin_cost(cap, permitted[-1]) / full, cap))
            room, b = min(costs)[1], len(bins)
            bins.append((0, 0))
        used = bins[b][1]
        bins[b] = (room - x, used + x)
        out.append((b, used))
    caps = [min(c for c in permitted if c >= used) for _, used in bins]
    return [b for b, _ in out], [at for _, at in out], [caps[b] for b, _ in out]


@given(h.lists(h.integers(1, 300), max_size=40))
def test_packs_like_a_naive_version(lengths):
    lengths, permitted = sorted(lengths, reverse=True), (64, 100, 300)
    assert pack(lengths, permitted) == naive(lengths, permitted)


def test_lengths_chosen_together_cost_no_more_than_one():
    rng = random.Random(3)
    permitted = (512, 1024, 2048, 4096, 8192)
    for high in (60, 500, 3000, 8000):
        lengths = sorted((rng.randrange(1, high) for _ in range(400)), reverse=True)
        total = lambda bins, caps: sum(bin_cost(c, 8192) for c in dict(zip(bins, caps)).values())
        bins, _, caps = cheapest(lengths, permitted)
        fixed = [len(set(pack(lengths, (c,))[0])) * bin_cost(c, 8192) for c in permitted if c >= high]
        joint = pack(lengths, permitted)
        assert total(bins, caps) <= min([*fixed, total(joint[0], joint[2])])


def test_packing_keeps_every_token(spark):
    rows = [(i % 90 if i else None, n) for i, n in enumerate([0, 5, None, 8192, 8193, 40_000, 1, 1, 700, 700] * 30)]
    got = best_fit_packing(spark.createDataFrame(rows, "doc_id long, length long"), in_shard=64).collect()
    assert sum(r.length for r in got) == sum(n or 0 for _, n in rows)
    assert sum(r.bin is None for r in got) == 60 and all(r.bin is None or r.capacity in LENGTHS for r in got)
    used: dict[int, list] = {}
    for r in got:
        if r.bin is not None:
            used.setdefault(r.bin, []).append(r)
    for parts in used.values():
        spans = sorted((r.place, r.place + r.length) for r in parts)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= parts[0].capacity
    assert best_fit_packing(spark.createDataFrame([], "doc_id long, length long")).count() == 0
