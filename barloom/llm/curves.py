"""Approximate nearest neighbours on shifted space-filling curves.

Every curve projects the unit vectors onto a few random directions, shifts
them at random and orders them along a Hilbert curve.  Near vectors are often
close on some curve.  Keys are cut into chunks of about equal size (split points
come from a bounded sample of vectors, every vector is indexed); Spark deals
rows by curve and chunk.  A query goes to its own chunk and the neighbouring
ones that make up its window; there it is compared in blocks, and the best of
all windows are merged and ranked by exact score.

A key has a byte for each of ``LEVELS`` halvings of the cells, so that vectors
nearer to one another than any fixed cell still lie in an order of their own on
every curve.

Vectors of one direction (copies, also rescaled ones) are one point with its few
smallest ids, which is all that a result can use.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import written
from barloom.llm.textkit import mix

#: Halvings of a cell: the last is near the resolution of doubles.
DIRECTIONS, LEVELS = 8, 40
SALTS = 64
#: Directions, and scores, count as equal where they agree at this many to one.
SAME = 1e12


@dataclass(frozen=True)
class Curves:
    """``count`` curves; a window holds at least ``window`` of all points.

    Without ``window`` the least one is taken that finds a share of ``recall`` of
    the nearest pairs of the sample.  ``chunk`` bounds a chunk's points; the
    sample that fits split points and window has ``sample`` points, or eight for
    each chunk, in at most ``sample_bytes``.
    """

    count: int = 18
    window: float | None = None
    recall: float = 0.955
    chunk: int = 16384
    sample: int = 20000
    sample_bytes: int = 1 << 26
    seed: int = 11


def _transposed(cells: np.ndarray, bits: int) -> list[np.ndarray]:
    """Coordinates whose bits, taken level by level, are the place along the
    Hilbert curve, by Skilling's transposition (2004)."""
    x = [c.astype(np.uint64) for c in cells.T]
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(len(x)):
            on = (x[i] & np.uint64(q)) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0]) ^ swap
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & np.uint64(q)) != 0, turn ^ np.uint64(q - 1), turn)
        q >>= 1
    return [c ^ turn for c in x]


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of cells (rows of small integers)."""
    x, one = _transposed(cells, bits), np.uint64(1)
    key = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for c in x:
            key = (key << one) | ((c >> np.uint64(b)) & one)
    return key


def hilbert_bytes(cells: np.ndarray, bits: int) -> np.ndarray:
    """The same places as bytes (rows), one for each level, for at most eight
    coordinates of any number of bits."""
    x, one = _transposed(cells, bits), np.uint64(1)
    out = np.zeros((len(cells), bits), np.uint8)
    for b in range(bits):
        for c in x:
            level = out[:, bits - 1 - b]
            level <<= 1
            level |= ((c >> np.uint64(b)) & one).astype(np.uint8)
    return out


class _Order:
    """The curves' projections, and from a sample their scale and split points."""

    def __init__(self, sample: np.ndarray, chunks: int, setting: Curves) -> None:
        rng = np.random.default_rng(setting.seed)
        size = sample.shape[1]
        self.axes = [np.linalg.qr(rng.normal(size=(size, min(DIRECTIONS, size))))[0] for _ in range(setting.count)]
        self.shift = [rng.uniform(-0.1, 0.1, a.shape[1]) for a in self.axes]
        self.scale = 0.16 / max(float((sample @ self.axes[0]).std()), 1e-9)
        self.splits = []
        nobody = np.arange(len(sample))
        for c in range(setting.count):
            keys = np.sort(self.keys(c, sample, nobody))
            self.splits.append(keys[np.linspace(0, len(keys), chunks + 1).astype(int)[1:-1]])

    def keys(self, curve: int, unit: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Keys; four last bytes from id and curve split points that share a cell."""
        at = unit @ self.axes[curve] * self.scale + 0.5 + self.shift[curve]
        cells = (np.clip(at, 0, 1 - 2.0**-LEVELS) * 2.0**LEVELS).astype(np.int64)
        tail = mix(node.astype(np.uint64) * np.uint64(2 * len(self.axes) + 1) + np.uint64(curve)) >> np.uint64(32)
        whole = np.concatenate([hilbert_bytes(cells, LEVELS), tail.astype(">u4").view(np.uint8).reshape(-1, 4)], axis=1)
        return np.ascontiguousarray(whole).view(f"S{whole.shape[1]}")[:, 0]

    def window(self, sample: np.ndarray, k: int, recall: float, queries: int = 400) -> float:
        """The share of the points that a window needs: twice the distance along
        the best curve, in ranks, of ``recall`` of the sample's nearest pairs."""
        n, asked = len(sample), min(queries, len(sample))
        if n <= k + 1:
            return 1.0
        near = sample[:asked] @ sample.T
        near[np.arange(asked), np.arange(asked)] = -2
        true = np.argpartition(-near, k, axis=1)[:, :k]
        best = np.full(true.shape, n)
        for c in range(len(self.axes)):
            rank = np.empty(n, np.int64)
            rank[np.argsort(self.keys(c, sample, np.arange(n)), kind="stable")] = np.arange(n)
            best = np.minimum(best, np.abs(rank[true] - rank[:asked, None]))
        return min(1.0, 2 * float(np.quantile(best, recall)) / n)

    def chunk(self, curve: int, unit: np.ndarray, node: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.splits[curve], self.keys(curve, unit, node), "right")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _ways(vectors: DataFrame) -> DataFrame:
    """With two hashes (128 bits) of the direction, rounded just above the noise of doubles."""
    e, way = F.col("embedding"), F.col("way")
    over = lambda x, y: F.zip_with(x, F.array_repeat(y, F.size(x)), lambda a, b: a / b)  # noqa: E731  (y once a row)
    rows = vectors.withColumn("way", over(e, F.array_max(F.transform(e, F.abs))))
    rows = rows.withColumn("way", over(way, F.sqrt(F.aggregate(way, F.lit(0.0), lambda s, x: s + x * x))))
    rows = rows.withColumn("way", F.transform(way, lambda x: F.rint(x * SAME).cast("long")))
    return rows.select("vec_id", "embedding", F.xxhash64("way").alias("h"), F.xxhash64(F.lit(1), "way").alias("h2"))


def _points(vectors: DataFrame, few: int) -> DataFrame:
    """One row for each different direction: smallest id, the few smallest ids."""
    salted = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    inside = Window.partitionBy("h", "h2", "salt").orderBy("vec_id")
    some = salted.withColumn("nth", F.row_number().over(inside)).where(F.col("nth") <= few)
    lists = some.groupBy("h", "h2").agg(
        F.slice(F.sort_array(F.collect_list("vec_id")), 1, few).alias("ids"), F.min_by("embedding", "vec_id").alias("embedding")
    )
    return lists.select("h", "h2", F.col("ids")[0].alias("node"), "ids", "embedding")


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` without nulls, zeros and non-finite components,
    and of the most common length."""
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long"), e.cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0))
    rows = rows.where(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0))
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (common.n if common else 0))


def nearest(vectors: DataFrame, is_query: F.Column | str, k: int = 5, setting: Curves = Curves()) -> DataFrame:
    """The k nearest found for each query row by cosine: ``query_id, rank,
    vec_id, score``; all other rows are candidates.

    Vectors that are null, zero, not finite or of an odd length take no part.
    Rows that repeat a vec_id and a direction count once; a row of the query's
    vec_id with another direction is a candidate.  Scores that agree to
    twelve decimals tie, and go by vec_id.  With fewer than k
    candidates all are returned; an empty table gives no rows.  ``window`` is a
    share of the points because in data without structure (unit vectors at
    random) a fixed number of neighbours would lose recall as points are added;
    it is measured on the sample.  Other columns are left out.
    """
    rows = written(_ways(usable(vectors)).dropDuplicates(["vec_id", "h", "h2"]), "vectors")
    few = k + 1
    points = written(_points(rows, few), "points")
    asks = rows.where(is_query).join(points.select("h", "h2", "node"), ["h", "h2"]).select(F.col("vec_id").alias("query_id"), "node", "h")
    asks = written(asks, "asks")
    total = points.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return rows.sparkSession.createDataFrame([], schema)
    size = points.select(F.size("embedding")).first()[0]
    chunks = max(-(-total // setting.chunk), min(64, -(-total // 128)))
    some = min(max(setting.sample, 8 * chunks), max(setting.sample_bytes // (8 * size), 1000))
    sample = points.orderBy(F.xxhash64("node"), "h").limit(some).select("embedding").toArrow()
    unit = _unit(_matrix(sample.column("embedding").combine_chunks(), size))
    order = _Order(unit, chunks, setting)
    window = order.window(unit, k, setting.recall) if setting.window is None else setting.window
    reach = max(1, int(np.ceil((window * chunks - 1) / 2))) if chunks > 1 else 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each point to its chunk of every curve, each query to its window."""
        for b in batches:
            u = _unit(_matrix(b.column("embedding"), size))
            node = b.column("node").to_numpy(zero_copy_only=False)
            asked = np.flatnonzero(b.column("asked").to_numpy(zero_copy_only=False))
            others = [b.column(x) for x in ("node", "h", "ids", "embedding")]
            for c in range(setting.count):
                home = order.chunk(c, u, node)
                for d in range(-reach, reach + 2):
                    if d > reach:
                        chosen, at, ask = np.arange(len(u)), home, False
                    else:  # a window that would pass an end reaches further on the other side
                        middle = np.clip(home[asked], min(reach, chunks - 1), max(chunks - 1 - reach, 0))
                        at, ask = middle + d, True
                        inside = (at >= 0) & (at < chunks)
                        chosen, at = asked[inside], at[inside]
                    pick = pa.array(chosen)
                    n = len(chosen)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, c, np.int32)), pa.array(at.astype(np.int32)), pa.array(np.full(n, ask)),
                            *(x.take(pick) for x in others)
                        ],
                        names=["curve", "chunk", "ask", "node", "h", "ids", "embedding"],
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by curve and chunk, points before queries."""
        where, ids, whole, marks = None, [], [], []
        matrix = lengths = flat = None
        for b in batches:
            curve, chunk, ask = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((curve[1:] != curve[:-1]) | (chunk[1:] != chunk[:-1]) | (ask[1:] != ask[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
                if where != (curve[lo], chunk[lo]):
                    where, ids, whole, marks, matrix = (curve[lo], chunk[lo]), [], [], [], None
                part = b.slice(lo, hi - lo)
                x = _matrix(part.column("embedding"), size)
                if not ask[lo]:
                    whole.append(x)
                    marks.append(part.column("h").to_numpy(zero_copy_only=False))
                    ids.extend(part.column("ids").to_pylist())
                    continue
                if not whole:
                    continue
                if matrix is None:
                    matrix, mark = np.concatenate(whole), np.concatenate(marks)
                    norms = np.linalg.norm(matrix, axis=1)
                    lengths = np.array([len(i) for i in ids])
                    flat = np.array([y for i in ids for y in i])
                    begin = np.cumsum(lengths) - lengths
                    directions = matrix / norms[:, None]
                nodes, ways = (part.column(x).to_numpy(zero_copy_only=False) for x in ("node", "h"))
                out_q, out_h, out_v, out_s, out_o = [], [], [], [], []
                for a in range(0, len(x), 256):
                    near = _unit(x[a : a + 256]) @ directions.T
                    cut = max(near.shape[1] - few, 0)
                    least = np.partition(near, cut, axis=1)[:, cut]
                    who, js = np.nonzero(near >= least[:, None] - 2 / SAME)  # with all ties at the cut
                    tie = np.lexsort((flat[begin[js]], -np.rint(near[who, js] * SAME), who))
                    who, js = who[tie], js[tie]
                    starts = np.searchsorted(who, np.arange(len(near) + 1))
                    for i in range(len(near)):
                        some = js[starts[i] : min(starts[i + 1], starts[i] + few + 2)]
                        q = x[a + i]
                        score = (matrix[some] * q).sum(axis=1) / (norms[some] * np.sqrt((q * q).sum()))
                        level = (-np.rint(score * SAME)).tolist()
                        same = (mark[some] == ways[a + i]).tolist()
                        found = sorted(
                            (r, v, s, o) for j, r, s,
                            o in zip(some.tolist(), level, score.tolist(), same) for v in flat[begin[j] : begin[j] + lengths[j]].tolist()
                        )[:few]
                        out_q += [nodes[a + i]] * len(found)
                        out_h += [ways[a + i]] * len(found)
                        out_v += [v for _, v, _, _ in found]
                        out_s += [s for _, _, s, _ in found]
                        out_o += [o for _, _, _, o in found]
                values = zip((out_q, out_h, out_v, out_s, out_o), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in values], names=["node", "h", "vec_id", "score", "own"])

    point = ["node", "h"]
    marked = points.join(asks.select(*point).distinct().withColumn("asked", F.lit(True)), point, "left")
    marked = marked.select(*point, "ids", "embedding", F.coalesce("asked", F.lit(False)).alias("asked"))
    dealt = marked.mapInArrow(deal, "curve int, chunk int, ask boolean, node long, h long, ids array<long>, embedding array<double>")
    dealt = dealt.repartition("curve", "chunk").sortWithinPartitions("curve", "chunk", "ask")
    pairs = dealt.mapInArrow(compare, "node long, h long, vec_id long, score double, own boolean")
    pairs = pairs.groupBy(*point, "vec_id", "own").agg(F.max("score").alias("score"))
    pairs = pairs.withColumn("far", -F.rint(F.col("score") * SAME))
    by_score = [F.col("far"), F.col("vec_id")]
    best = pairs.withColumn("nth", F.row_number().over(Window.partitionBy(*point).orderBy(*by_score))).where(F.col("nth") <= few).drop("nth")
    best = best.groupBy(*point).agg(F.sort_array(F.collect_list(F.struct("far", "vec_id", "score", "own"))).alias("best"))
    own = F.slice(F.filter("best", lambda x: ~x["own"] | (x["vec_id"] != F.col("query_id"))), 1, k)
    listed = asks.join(best, point).select("query_id", F.posexplode(own).alias("at", "hit"))
    return listed.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )
