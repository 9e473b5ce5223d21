"""Repeated passages across documents, by seed and extend.

Seeds are winnowed anchors: of every ``window`` consecutive words, the one
k-word gram with the smallest hash.  Each window has just one anchor, found in
its own words alone, so equal windows have equal anchors at the same place.
The stretch of words of all windows of an anchor is its context.

Documents meet on equal anchors.  Where whole contexts agree the match extends
both ways over all the anchor's windows at once; where an anchor has several
contexts (the ends of a passage, edited copies) it extends word by word: the
hash of each of its windows is compared.  Windows that meet or overlap merge to
maximal repeats.  So work and rows follow the text, and never the pairs of
documents that share it: extending pair by pair would compare all pairs of an
anchor that many documents hold.  Equality rests on 128 bits of hash: anchors are
hashed in one lane, contexts and windows in the other, down to the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import left_lookup, written
from barloom.llm.textkit import U64, Slice, gram_hash, mix, ranges, slices


def _leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, where the smallest of values[i:i+width] is (the first one)."""
    low, at, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        right = low[step:] < low[:-step]
        low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
        size += step
    return at


def _anchors_of(part: Slice, window: int, k: int) -> tuple[np.ndarray, ...]:
    words = part.hashes()
    if len(words) < window:
        return (np.zeros(0, np.int64),) * 6
    grams, whole = gram_hash(words, k), gram_hash(part.hashes(1), window)
    at = _leftmost_min(grams, window - k + 1)
    p = np.flatnonzero(np.arange(len(at)) + window <= part.first[1:][part.doc[: len(at)]])
    if not len(p):
        return (np.zeros(0, np.int64),) * 6
    a = at[p]
    begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1) | (part.doc[p[1:]] != part.doc[p[:-1]])]))
    n = np.diff(np.append(begin, len(p)))
    lo, a = p[begin], a[begin]
    # the first and the last window cover the context
    context = mix(whole[lo] + mix(whole[lo + n - 1]) + mix((n * 1024 + a - lo).astype(U64)))
    doc = part.doc[lo]
    return grams[a].view(np.int64), context.view(np.int64), doc, (lo - part.first[doc]), n, a - lo


def anchors(docs: DataFrame, window: int, k: int) -> DataFrame:
    """``doc_id, v, text`` -> a row per anchor: its gram, its context, and the
    first window (``lo``, in words) and number (``n``) of its windows."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, versions = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for lo, hi, part in slices(b.column(2)):
                gram, context, doc, at, n, _ = _anchors_of(part, window, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram), pa.array(context), pa.array(ids[lo:hi][doc].astype(np.int64)), pa.array(versions[lo:hi][doc]),
                        pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))
                    ],
                    names=["gram", "context", "doc_id", "v", "lo", "n"],
                )

    rows = docs.where("doc_id is not null").select("doc_id", "v", "text")
    return rows.mapInArrow(job, "gram long, context long, doc_id long, v long, lo int, n int")


def _windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``wanted(doc_id, v, gram, lo, n)`` -> the hash of each of these windows."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, part in slices(b.column(2)):
                lists = b.column(3).slice(lo, hi - lo)
                of = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                gram, start, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                whole = gram_hash(part.hashes(1), window)
                at = ranges(part.first[of] + start, n)
                fits = at + window <= np.repeat(part.first[of + 1], n)
                at, who, gram = at[fits], np.repeat(of, n)[fits], np.repeat(gram, n)[fits]
                h = whole[at]
                ids, versions = (b.column(i).to_numpy(zero_copy_only=False)[lo:hi] for i in range(2))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram), pa.array(h.view(np.int64)), pa.array(ids[who]), pa.array(versions[who]),
                        pa.array((at - part.first[who]).astype(np.int32))
                    ],
                    names=["gram", "h", "doc_id", "v", "at"],
                )

    lists = wanted.groupBy("doc_id", "v").agg(F.collect_list(F.struct("gram", "lo", "n")).alias("wanted"))
    return docs.join(lists, ["doc_id", "v"]).select("doc_id", "v", "text", "wanted").mapInArrow(job, "gram long, h long, doc_id long, v long, at int")


def _versions(docs: DataFrame) -> DataFrame:
    """With ``v``, a hash of the text where an id has several texts, else 0."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    h = F.xxhash64("text")
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("a <> b")
    several = written(several.select("doc_id", F.lit(True).alias("several")), "several")
    if several.limit(1).count() == 0:
        return docs.withColumn("v", F.lit(0).cast("long"))
    return left_lookup(docs, several).withColumn("v", F.when(F.col("several"), h).otherwise(F.lit(0).cast("long"))).drop("several")


def _merged(spans: DataFrame) -> DataFrame:
    """Spans that meet or overlap become one."""
    order = Window.partitionBy("doc_id", "v").orderBy("start", "stop")
    far = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.when(F.col("start") <= far, 0).otherwise(1)).withColumn(
        "run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return runs.groupBy("doc_id", "v", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def repeated_spans(docs: DataFrame, window: int = 50, k: int = 12) -> DataFrame:
    """``doc_id, text`` -> maximal spans of words ``doc_id, v, start, stop`` whose
    windows all start in a document with a smaller doc_id too.  ``v`` is 0, but a
    hash of the text where rows of one doc_id differ in it."""
    return _merged(_matches(docs if "v" in docs.columns else _versions(docs), window, k))


def _matches(docs: DataFrame, window: int, k: int) -> DataFrame:
    """The spans before they merge."""
    seeds = written(anchors(docs, window, k), "anchors")
    classes = seeds.groupBy("gram", "context").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    classes = written(classes, "contexts")
    met = classes.groupBy("gram").agg(
        F.min("low").alias("a"), F.max("high").alias("b"), F.count("*").alias("k")
    ).where("a < b").select("gram", (F.col("k") > 1).alias("several"))
    info = classes.join(met, "gram").where("several or low < high").select("gram", "context", "low", "several")
    matched = written(
        seeds.join(info, ["gram", "context"]).where("doc_id > low or several").select(
            "gram", "doc_id", "v", "lo", "n", (F.col("doc_id") > F.col("low")).alias("whole")
        ),
        "matched"
    )
    whole = matched.where("whole").select("doc_id", "v", F.col("lo").alias("start"), (F.col("lo") + F.col("n") - 1 + window).alias("stop"))
    each = written(_windows(docs, matched.where("not whole"), window), "windows")
    lows = each.groupBy("gram", "h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("gram", "h", "low")
    ends = each.join(lows, ["gram", "h"]).where("doc_id > low").select(
        "doc_id", "v", F.col("at").alias("start"), (F.col("at") + window).alias("stop")
    )
    return whole.unionByName(ends)


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Take spans ``doc_id, v, start, stop`` of words out of the texts of
    ``doc_id, v, text``; the words left are joined by one space."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, part in slices(b.column(1)):
                lists = b.column(2).slice(lo, hi - lo)
                of = np.repeat(np.arange(hi - lo), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
                flat = lists.flatten()
                start, stop = (np.minimum(part.first[of] + flat.field(i).to_numpy(zero_copy_only=False), part.first[of + 1]) for i in range(2))
                m = len(part.starts)
                cover = np.cumsum(np.bincount(start.astype(int), minlength=m + 1) - np.bincount(stop.astype(int), minlength=m + 1))[:m] > 0
                left = np.flatnonzero(~cover)
                lengths = part.ends[left] - part.starts[left] + 1
                ends = np.cumsum(lengths)
                out = np.full(int(lengths.sum()), 32, np.uint8)
                solid = np.ones(len(out), bool)
                solid[ends - 1] = False
                out[solid] = part.data[ranges(part.starts[left], lengths - 1)]
                gone = np.bincount(part.doc[cover], minlength=part.n)
                edge = np.concatenate([[0], ends])[np.searchsorted(left, part.first)]
                text = out.tobytes()
                texts = [text[a : max(a, z - 1)].decode() for a, z in zip(edge[:-1].tolist(), edge[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo), pa.array(part.counts.astype(np.int64)), pa.array(gone.astype(np.int64)),
                        pa.array(texts, pa.string())
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    lists = spans.groupBy("doc_id", "v").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return left_lookup(docs, lists, ["v"]).select("doc_id", "text", "spans").mapInArrow(job, "doc_id long, n_words long, n_removed long, kept string")


def substring_dedup(docs: DataFrame, window: int = 50, k: int = 12) -> DataFrame:
    """Remove passages of ``window`` words or more that a document with a
    smaller doc_id holds too: ``doc_id, n_words, n_removed, kept``.

    Windows are judged on the input.  A null text has no words; texts shorter
    than a window stay whole; repeats inside one document (or in rows with the
    same doc_id) don't count; rows with a null doc_id stay whole and take
    nothing from others; rows that repeat a doc_id are judged each by its text.
    Other columns are left out.  An empty table gives no rows.
    """
    docs = _versions(docs)
    return remove_spans(docs, repeated_spans(docs, window, k))
