"""Vector codes: each part of a vector becomes the index of its codebook's nearest entry.

Codebooks are fitted in rounds on integers, so distances and results are exact.
The nearest entry is found by Exponion search: a part whose previous entry is a,
at distance d, has its nearest entry within 2d of a, since an entry j at most as
far has |a - j| <= |a - x| + |x - j| <= 2d.  So the entries are scanned in the order of
their distance to a, as far as (squared) 4 d*d reaches; ties go to the lower index.

A round is one pass over a table of the vectors and their codes so far.  Each
task also writes its sums by part and entry beside the rows it codes; Spark adds
these up and the driver gets one row for each part, entry and place in a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import deleted, written

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Components are floor(SCALE * x), held to +-LIMIT, so no sum of squares overflows.
SCALE, LIMIT = 4096, 1 << 24
#: Labels whose sums are broadcast; for more the join is a shuffle.
FEW_LABELS = 100_000
#: Tasks that rows of one label are spread over there.
SALT = 32


def integers(vectors: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)`` of finite vectors."""
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)


def neighbour_lists(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry all entries by distance (itself first), and the squared distances."""
    k = len(entries)
    apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    first = apart.copy()
    first[np.arange(k), np.arange(k)] = -1
    order = np.lexsort((np.broadcast_to(np.arange(k), (k, k)), first), axis=1)
    return order, np.take_along_axis(apart, order, axis=1)


def nearest_entries(points: np.ndarray, entries: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each point's nearest entry, from its previous one."""
    order, apart = neighbour_lists(entries)
    best, low = previous.astype(np.int64), ((points - entries[previous]) ** 2).sum(axis=1)
    reach, live = 4 * low, np.arange(len(points))
    for r in range(1, len(entries)):
        live = live[apart[previous[live], r] <= reach[live]]  # the lists ascend, so who stops is done
        if not len(live):
            break
        entry = order[previous[live], r]
        far = ((points[live] - entries[entry]) ** 2).sum(axis=1)
        better = (far < low[live]) | ((far == low[live]) & (entry < best[live]))
        at = live[better]
        best[at], low[at] = entry[better], far[better]
    return best, low


def _codes(vectors: np.ndarray, codebooks: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a column for each part) and summed squared distances."""
    out, error = np.empty_like(codes), np.zeros(len(vectors), np.int64)
    wide = codebooks.shape[2]
    for p in range(len(codebooks)):
        out[:, p], low = nearest_entries(vectors[:, p * wide : (p + 1) * wide], codebooks[p], codes[:, p])
        error += low
    return out, error


def _stacked(column: pa.Array, dims: int) -> np.ndarray:
    """A matrix from a column of binaries of ``dims`` numbers of four bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dims)


def _bytes_of(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def kept_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, label, ints`` (integers as bytes) of the vectors that take part."""
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("string"))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = b.filter(b.column(1).is_valid())
            lists = some.column(1)
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)  # null components become NaN
            good = np.add.reduceat(np.append(np.isfinite(flat), False).astype(np.int64), np.append(0, np.cumsum(n))[:-1].astype(int)) if len(n) else n
            keep = (n > 0) & (good == n)
            edge = np.append(0, np.cumsum(n)).astype(int)
            ints = integers(np.where(np.isfinite(flat), flat, 0)).astype("<i4")
            found = [ints[a:z].tobytes() for a, z, k in zip(edge[:-1], edge[1:], keep) if k]
            some = some.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(found, pa.binary())], names=["vec_id", "label", "ints"])

    return rows.mapInArrow(job, "vec_id long, label string, ints binary")


def _pass(rows: DataFrame, codebooks: np.ndarray, dims: int) -> DataFrame:
    """Rows with new ``codes`` and ``error``; with ``kind`` 1, the task's sums by part and
    entry (``code`` = part * 256 + entry, ``n`` points, ``sums`` by place)."""
    parts, entries, wide = codebooks.shape

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, wide), np.int64)
        for b in batches:
            vectors = np.zeros((len(b), parts * wide), np.int64)
            vectors[:, :dims] = _stacked(b.column("ints"), dims)
            old = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(len(b), parts)
            codes, error = _codes(vectors, codebooks, old)
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=entries)
                for d in range(wide):
                    np.add.at(sums[p, :, d], codes[:, p], vectors[:, p * wide + d])
            nothing = pa.nulls(len(b), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(len(b), np.int32)), b.column("vec_id"), b.column("label"), b.column("ints"), _bytes_of(codes), pa.array(error),
                    nothing, nothing, pa.nulls(len(b), pa.list_(pa.int64()))
                ],
                names=names,
            )
        p, e = np.nonzero(count)
        lists = pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))
        ids, texts, data = (pa.nulls(len(p), t) for t in (pa.int64(), pa.string(), pa.binary()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(p), np.int32)), ids, texts, data, data, ids, pa.array(p * 256 + e), pa.array(count[p, e]), lists], names=names
        )

    names = ["kind", "vec_id", "label", "ints", "codes", "error", "code", "n", "sums"]
    return rows.select("vec_id", "label", "ints", "codes").mapInArrow(
        job, "kind int, vec_id long, label string, ints binary, codes binary, error long, code long, n long, sums array<long>"
    )


def _moved(codebooks: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Each entry at the floor of its points' mean; entries without points stay."""
    each = sums.select("code", "n", F.posexplode("sums").alias("d", "x")).groupBy("code", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = codebooks.copy()
    for r in each.collect():  # parts x entries x places in a part
        out[r.code >> 8, r.code & 255, r.d] = r.x // r.n
    return out


def fit_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame | None, np.ndarray]:
    """Codes of ``vec_id, embedding, label``: a table ``vec_id, label, codes, error`` (codes as
    bytes, one a part) and the codebooks (part, entry, place); None for no vectors."""
    kept = written(kept_vectors(rows), "kept")
    order = [F.col("vec_id").asc_nulls_last(), F.col("ints")]
    one = kept.orderBy(*order).first()
    if one is None:
        deleted(kept)
        return None, np.zeros((parts, 0, 0), np.int64)
    dims, now = len(one.ints) // 4, kept.where(F.length("ints") == len(one.ints))
    first = now.orderBy(*order).limit(entries).collect()
    wide = -(-dims // parts)
    start = np.zeros((len(first), parts * wide), np.int64)
    start[:, :dims] = [np.frombuffer(r.ints, "<i4") for r in first]
    codebooks = np.ascontiguousarray(start.reshape(len(first), parts, wide).transpose(1, 0, 2))
    now, last = now.withColumn("codes", F.lit(bytearray(parts))), kept
    for r in range(rounds + 1):
        table = written(_pass(now, codebooks, dims), "codes")
        deleted(last)
        now, last = table.where("kind = 0"), table
        if r < rounds:
            codebooks = _moved(codebooks, table.where("kind = 1"))
    return now.select("vec_id", "label", "codes", "error"), codebooks


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def code_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of ``vec_id, embedding, label``.

    Vectors that are null, empty, or hold null or non-finite components take no part.
    The number of components is that of the vector with the smallest vec_id (null last,
    ties by the vector); vectors of another length take no part; parts are padded with
    zeros where that number is no multiple of eight.  Components beyond +-4,096 count
    as that.  Repeated rows are coded each; other columns are left out; an empty
    table gives no rows.
    """
    coded, codebooks = fit_codes(rows)
    if coded is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    totals = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    named, none = F.coalesce("label", F.lit("")), F.col("label").isNull()
    left, right = coded.withColumn("__l", named).withColumn("__n", none), totals.withColumn("__l", named).withColumn("__n", none).drop("label")
    if totals.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        both = left.join(F.broadcast(right), ["__l", "__n"])
    else:
        left = left.withColumn("__s", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALT)))
        right = right.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        both = left.join(right, ["__l", "__n", "__s"])
    return both.select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256")
    )
