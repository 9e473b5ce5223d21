"""Line deduplication with levelled sorted runs of line hashes.

Documents come in batches of falling doc_id.  A batch's distinct line keys
are merge-anti-joined with the runs of all earlier batches: keys that no run
holds become a sorted run of their own, with the largest doc_id that has them
(no later batch can have a larger one); keys that are held only add to a count.
Two runs of one level are compacted into one of the next, so a batch meets a
number of runs that is logarithmic in the number of batches.

Batches and runs are tables in as many buckets of the hash, each bucket one
sorted file: joins and compactions merge them bucket by bucket, and runs are
never shuffled again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import left_lookup, run_dir, written

SPACE = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
HOT_KEYS = 1000


def line_key(line: str, min_chars: int) -> tuple[int, int] | None:
    """The two hashes of a line's key, or None if the key is shorter than the limit."""
    key = line.strip(SPACE)
    if len(key) < min_chars:
        return None
    data = key.encode().lower()
    return tuple(h - (h >> 63 << 64) for h in (xxhash.xxh64_intdigest(data, 42), xxhash.xxh64_intdigest(data + b"\n", 42)))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, h1, h2``: the hashes, as in ``line_key``, of each distinct key of each text."""
    keys = F.transform(F.split("text", "\n"), lambda x: F.translate(F.btrim(x, F.lit(SPACE)), UPPER, LOWER))
    keys = F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= min_chars))
    lines = docs.where("doc_id is not null").select("doc_id", F.explode(keys).alias("key"))
    return lines.select("doc_id", F.xxhash64("key").alias("h1"), F.xxhash64(F.concat("key", F.lit("\n"))).alias("h2"))


class LineRuns:
    """Sorted runs ``h1, h2, n, last`` by level; no key is in two of them.

    The object may be kept and take in further batches, each of smaller ids
    than all before, at any time while its tables are.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[DataFrame | None] = []
        self.counted: list[DataFrame] = []
        # one file a bucket: the scan may tell Spark that its rows are sorted
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def add(self, batch: DataFrame) -> None:
        """Take in a batch ``doc_id, h1, h2`` of smaller ids than all before."""
        new = batch.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        runs = [r for r in self.levels if r is not None]
        if runs:
            joined, flags = self._bucketed(new, "batch"), []
            for i, run in enumerate(runs):
                flags.append(f"held{i}")
                joined = joined.join(run.select(*KEY, F.lit(True).alias(flags[-1])).hint("merge"), KEY, "left")
            held = F.coalesce(*flags, F.lit(False))
            new = joined.where(~held).select(*KEY, "n", "last")
            self.counted.append(self._bucketed(joined.where(held).select(*KEY, "n"), "counts"))
        run, level = self._bucketed(new, "run"), 0
        while level < len(self.levels) and self.levels[level] is not None:
            run, self.levels[level] = self._compacted(self.levels[level], run), None
            level += 1
        self.levels[level:level + 1] = [run]

    def _compacted(self, a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*KEY, F.col("n").alias("m"), F.col("last").alias("end"))
        both = a.join(b.hint("merge"), KEY, "full_outer")
        return self._bucketed(both.select(*KEY, F.coalesce("n", "m").alias("n"), F.coalesce("last", "end").alias("last")), "run")

    def _bucketed(self, rows: DataFrame, name: str) -> DataFrame:
        table = f"barloom_{name}_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY)
        writer.option("path", f"{run_dir(self.spark)}/{table}").saveAsTable(table)
        return self.spark.table(table)

    def totals(self) -> DataFrame:
        """``h1, h2, n, last`` over all batches."""
        runs = reduce(DataFrame.unionByName, [r for r in self.levels if r is not None])
        more = [c.select(*KEY, "n", F.lit(None).cast("long").alias("last")) for c in self.counted]
        return reduce(DataFrame.unionByName, more, runs).groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Drop lines that many documents share: ``doc_id, n_lines, n_dropped, kept``.

    A line's key is the line without ASCII white space at its ends, A-Z
    lower-cased.  Keys of at least ``min_chars`` code points in at least
    ``min_docs`` documents lose all their lines except in the largest doc_id
    that holds them (all its lines with that key stay).  A null or empty text
    is one empty line.  Rows with a null doc_id stay whole and count for
    nothing; rows that repeat a doc_id count as one document and are treated
    alike.  An empty table gives no rows.  Columns named in ``keep`` stay, after
    the others.
    """
    keep = keep or []
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep)
    cuts = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    place = reduce(lambda a, c: a + (F.col("doc_id") > int(c)).cast("int"), cuts, F.lit(0))
    lines = written(line_hashes(docs, min_chars).withColumn("batch", place), "lines", "batch")
    runs = LineRuns(docs.sparkSession)
    for i in reversed(range(len(cuts) + 1)):
        runs.add(lines.where(F.col("batch") == i).select("doc_id", *KEY).distinct())
    common = written(runs.totals().where(F.col("n") >= min_docs), "common")
    # Keys with more than a thousandth of all lines are less than a thousand:
    # they are broadcast, so that no task gets all lines of such a key.
    many = lines.count() / HOT_KEYS
    hot = F.broadcast(common.where(F.col("n") > many).select(*KEY, F.col("last").alias("hot_last")))
    tagged = lines.join(hot, KEY, "left")
    met = tagged.where("hot_last is null").join(common.where(F.col("n") <= many).select(*KEY, "last"), KEY)
    met = met.select("doc_id", *KEY, "last").unionByName(tagged.where("hot_last is not null").select("doc_id", *KEY, F.col("hot_last").alias("last")))
    drops = met.where("doc_id <> last").groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("drops"))

    def job(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            total, gone, kept = [], [], []
            for text, keys in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts = (text or "").split("\n")
                total.append(len(parts))
                if keys:
                    out = {(k["h1"], k["h2"]) for k in keys}
                    parts = [x for x in parts if line_key(x, min_chars) not in out]
                gone.append(total[-1] - len(parts))
                kept.append("\n".join(parts))
            others = [b.column(3 + i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), *others],
                names=["doc_id", "n_lines", "n_dropped", "kept", *keep]
            )

    wide = left_lookup(docs, drops).select("doc_id", "text", "drops", *keep)
    schema = wide.select("doc_id").schema.add("n_lines", "long").add("n_dropped", "long").add("kept", "string")
    for name in keep:
        schema = schema.add(wide.schema[name])
    return wide.mapInArrow(job, schema)
