"""Best-fit packing of documents into bins of several permitted lengths.

Rows are dealt by hash into shards of a few thousand, so shards are packed
side by side at any size of the input.  In a shard, pieces go from long to
short into the open bin that they fill best.  Where none has room a bin is
opened, of the length whose cost for each token put in is least when the pieces
still to come fill it greedily.  At the end each bin shrinks to the shortest
permitted length that holds its contents.  A shard for which bins of one length
alone come out cheaper takes those.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import written

LENGTHS = (512, 1024, 2048, 4096, 8192)
IN_SHARD = 4096
SCHEMA = "doc_id long, piece int, length long, bin long, capacity long, place long"


def bin_cost(capacity: int, longest: int) -> float:
    """Compute for a sequence: linear layers, attention, and a fixed part."""
    return capacity * (1 + capacity / (4 * longest)) + 16


class _Left:
    """How many pieces of each length are still to come."""

    def __init__(self, lengths: list[int]) -> None:
        self.count: dict[int, int] = {}
        for x in lengths:
            self.count[x] = self.count.get(x, 0) + 1
        self.known = sorted(self.count)

    def take(self, x: int) -> None:
        self.count[x] -= 1
        if not self.count[x]:
            del self.known[bisect_left(self.known, x)]

    def fill(self, room: int) -> int:
        """Tokens that the largest pieces that fit, one after the other, put in
        until none fits."""
        full, end = 0, len(self.known)
        while True:
            i = bisect_right(self.known, room - full, 0, end) - 1
            if i < 0:
                return full
            x = self.known[i]
            full += x * min(self.count[x], (room - full) // x)
            end = i


def pack(lengths: list[int], permitted: tuple[int, ...] = LENGTHS, opening: tuple[int, ...] | None = None) -> tuple[list[int], list[int], list[int]]:
    """Bins, places and capacities for pieces sorted from long to short; bins are
    opened in the lengths ``opening`` (all that are permitted)."""
    permitted, left = tuple(sorted(permitted)), _Left(lengths)
    opening = permitted if opening is None else opening
    open_bins: list[tuple[int, int]] = []  # room, bin
    used, bins, places = [], [], []
    for x in lengths:
        left.take(x)
        i = bisect_left(open_bins, (x, -1))
        if i < len(open_bins):
            room, b = open_bins.pop(i)
        else:
            costs = [(bin_cost(c, permitted[-1]) / (x + left.fill(c - x)), c) for c in opening if c >= x]
            room, b = min(costs)[1], len(used)
            used.append(0)
        bins.append(b)
        places.append(used[b])
        used[b] += x
        if room > x:
            insort(open_bins, (room - x, b))
    shrunk = [permitted[bisect_left(permitted, u)] for u in used]
    return bins, places, [shrunk[b] for b in bins]


def cheapest(lengths: list[int], permitted: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """The cheapest of packing with all lengths chosen as bins are opened and of
    opening bins of one length alone."""
    longest = max(permitted)
    found = []
    for opening in (None, *((c,) for c in permitted if lengths and c >= lengths[0])):
        bins, places, caps = pack(lengths, permitted, opening)
        cost = sum(bin_cost(c, longest) for c in dict(zip(bins, caps)).values())
        found.append((cost, len(found), (bins, places, caps)))
    return min(found)[2]


def best_fit_packing(items: DataFrame, permitted: tuple[int, ...] = LENGTHS, in_shard: int = IN_SHARD) -> DataFrame:
    """``doc_id, length`` -> ``doc_id, piece, length, bin, capacity, place``.

    Items longer than the longest permitted length are cut into pieces of that
    length and a rest.  Items of length zero or null come out with length 0 and
    no bin.  Repeated rows are packed each, and rows alike in every column are
    told apart by their place in the written table, so no shard takes more than
    its share of them; an empty table gives no rows.  Pieces of one bin lie one
    after the other from place 0.  Other columns of ``items`` are left out.
    """
    longest = max(permitted)
    items = items.select(F.col("doc_id").cast("long"), F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("total"))
    last = F.greatest(F.ceil(F.col("total") / longest) - 1, F.lit(0))
    pieces = items.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    pieces = pieces.select("doc_id", F.col("piece").cast("int"), F.least(F.col("total") - F.col("piece") * longest, F.lit(longest)).alias("length"))
    pieces = written(pieces, "pieces")
    n = pieces.count()
    shards = max(1, -(-n // in_shard))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length", F.monotonically_increasing_id()), F.lit(shards)))

    def job(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        some = rows[rows.length > 0]
        bins, places, caps = cheapest(some.length.tolist(), permitted)
        out = rows[["doc_id", "piece", "length"]].copy()
        out["bin"] = pd.array([key[0] * 2**32 + b for b in bins] + [None] * (len(rows) - len(some)), "Int64")
        out["capacity"] = pd.array(caps + [None] * (len(rows) - len(some)), "Int64")
        out["place"] = pd.array(places + [None] * (len(rows) - len(some)), "Int64")
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return pieces.groupBy("shard").applyInPandas(job, SCHEMA)
