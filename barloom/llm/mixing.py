"""Mixing sources to target weights on a low-discrepancy schedule.

Point j of the golden-ratio sequence falls into one source's share of the
cumulative targets: slot j belongs to that source, and slots of all sources
interleave evenly.  Each source's documents, in a hashed order, lie on a line
of words that is cut into blocks of equal size; the r-th slot of a source joins
block r modulo the number of blocks, so the line is passed over again until the
target is reached.  Ranks and places on the line are sums over small chunks,
over steps of chunks and over steps, so no task holds a source.  Rows alike in
id, text and source are counted first and lie on the line in lots, so no chunk
takes all copies of a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import sums_before, word_count, written

#: Words of a slot; the targets are met to the word at any length.
BLOCK_WORDS = 1024
SLOTS_IN_CHUNK = 4096
DOCS_IN_BUCKET = 256
CELLS = 1024
#: 2**32 divided by the golden ratio, odd.
GOLDEN = 2654435769


@dataclass
class Mix:
    """``sources``: sid, source, source_size, target, words; ``schedule``: the
    slots (position, sid, block, pass, words); ``pieces``: where each row of the
    input lies on its source's line; ``taken``: pieces met by slots."""

    sources: DataFrame
    schedule: DataFrame
    rows: DataFrame
    taken: DataFrame


def source_targets(sources: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """Targets of ``sources(source, source_size)``; one row for each source.

    Sources by code point (null last) take the weights in turn and share
    ``share`` of all sizes by weight; where a target would pass ``most`` times its
    source's size it stops there and the others share the excess: sources fill
    in the order of limit to weight, up to a level common to the rest.  These
    windows run over the sources in one task (one short row for each).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = sources.withColumn("sid", F.row_number().over(by_name).cast("long") - 1)
    table = table.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    table = table.withColumn("limit", most * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("ratio", "sid")
    table = table.withColumn("total", share * F.sum("source_size").over(everything))
    before = F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    table = table.withColumn("level", (F.col("total") - F.coalesce(before, F.lit(0.0))) / left)
    first_open = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "sid", "level"))).over(everything)
    level = first_open["level"]
    target = F.least(F.col("limit"), F.coalesce(F.col("weight") * level, F.col("limit"))).cast("double")
    return table.select("sid", "source", "source_size", "n_rows", target.alias("target"))


def _places(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row's place (``at``) on its source's line of words, in hashed order."""
    lots = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(DOCS_IN_BUCKET).cast("long"))
    rows = rows.groupBy("doc_id", "mark", "source", "size").agg(F.count("*").alias("n")).withColumn("lot", F.explode(lots))
    rows = rows.withColumn("n", F.least(F.lit(DOCS_IN_BUCKET), F.col("n") - F.col("lot"))).withColumn("h", F.xxhash64("doc_id", "mark", "lot"))
    rows = rows.join(sources.select("sid", "source", "n_rows"), rows.source.eqNullSafe(sources.source)).drop("source", "lot")
    buckets = F.ceil(F.col("n_rows") / DOCS_IN_BUCKET)
    rows = rows.withColumn("bucket", F.floor((F.shiftrightunsigned("h", 11) / F.lit(2.0**53)) * buckets)).drop("n_rows")
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size")
    words = F.col("size") * F.col("n")
    rows = rows.withColumn("nth", F.row_number().over(inside)).withColumn(
        "at", F.sum(words).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - words
    ).drop("h")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    rows = rows.withColumn("at", F.col("at") + F.col("copy") * F.col("size")).withColumn("nth", F.col("nth") * DOCS_IN_BUCKET + F.col("copy")).drop("n", "copy")
    rows = written(rows, "places")
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    sums = sums_before(sums, "sid", "bucket", "words").drop("words")
    return rows.join(sums, ["sid", "bucket"]).withColumn("at", F.col("at") + F.col("base")).drop("base")


def _schedule(sources: DataFrame, block: int) -> DataFrame:
    """The slots ``position, sid, block, pass, words`` that reach every target."""
    spark = sources.sparkSession
    by_sid = Window.orderBy("sid")
    table = sources.where("words > 0").select(
        "sid", "source_size", "words", F.ceil(F.col("source_size") / block).alias("blocks"), F.floor(F.col("words") / F.col("source_size")).alias("full")
    )
    table = table.withColumn("slots", F.col("full") * F.col("blocks") + F.ceil((F.col("words") - F.col("full") * F.col("source_size")) / block))
    total = F.sum("slots").over(Window.partitionBy())
    table = table.withColumn("hi", F.sum("slots").over(by_sid) / total).withColumn("lo", (F.sum("slots").over(by_sid) - F.col("slots")) / total)
    table = written(table, "shares")
    n = table.agg(F.sum("slots")).first()[0] or 0
    cells = table.select(
        "sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell")
    )
    slots = spark.range(n).select(F.col("id").alias("position"), ((F.col("id") % 2**31) * GOLDEN % 2**32 / F.lit(2.0**32)).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * CELLS)).join(cells, "cell").where("u >= lo and u < hi")
    slots = slots.select("position", "sid", F.floor(F.col("position") / SLOTS_IN_CHUNK).alias("chunk"))
    slots = slots.withColumn("nth", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("position")) - 1)
    counts = written(slots.groupBy("sid", "chunk").agg(F.count("*").alias("n")), "counts")
    base = sums_before(counts, "sid", "chunk", "n").drop("n")
    ranked = slots.join(base, ["sid", "chunk"]).select("position", "sid", (F.col("nth") + F.col("base")).alias("rank"))
    # the points miss a source's share by a few slots; those come last
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    short = table.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    short = short.select(F.lit(n).alias("position"), "sid", F.explode(F.sequence("got", F.col("slots") - 1)).alias("rank"))
    slots = ranked.unionByName(short).join(table.select("sid", "source_size", "words", "blocks", "slots"), "sid").where("rank < slots")
    slots = slots.withColumn("block", F.col("rank") % F.col("blocks")).withColumn("pass", F.floor(F.col("rank") / F.col("blocks")))
    begin = F.col("block") * block
    left = F.col("words") - F.col("pass") * F.col("source_size") - begin
    return slots.select("position", "sid", "block", "pass", F.least(F.lit(block), F.col("source_size") - begin, left).alias("words"))


def mix_sources(
    docs: DataFrame, weights: list[int] | tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS,
    mark: Column | None = None
) -> Mix:
    """Mix ``doc_id, text, source`` to target weights (see ``source_targets``).

    A row's size is its number of words; null and empty texts have none and
    are never taken.  A null source is a source of its own, after all others.
    Each source is taken to its target, rounded to a word; only where a target
    ends inside a document is a part of it (its first words) taken.  A row is
    taken at most ``most`` times, rounded up.  The order depends on doc_id and
    text alone, so reruns agree.  ``mark``, a column of longs, tells apart rows of
    one doc_id and source (by default a hash of the text); columns of the input
    that happen to have the name of one made here are left out.  An empty table
    gives empty results.
    """
    mark = F.xxhash64(F.col("text").cast("string")) if mark is None else mark
    docs = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), mark.alias("mark"), word_count("text").alias("size"))
    docs = written(docs, "sizes")
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    sources = written(source_targets(sources, list(weights), share, most).withColumn("words", F.round("target").cast("long")), "targets")
    rows = written(_places(docs, sources), "rows")
    schedule = written(_schedule(sources, block), "schedule")
    span = F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))
    pieces = rows.where("size > 0").withColumn("block", F.explode(span))
    begin = F.greatest(F.col("at"), F.col("block") * block)
    end = F.least(F.col("at") + F.col("size"), F.col("block") * block + F.col("words"))
    met = pieces.join(schedule, ["sid", "block"]).withColumn("got", F.greatest(end - begin, F.lit(0)))
    taken = met.groupBy("sid", "bucket", "nth", "pass").agg(F.sum("got").alias("got")).where("got > 0")
    return Mix(sources, schedule, rows, taken)


def taken_words(mix: Mix) -> DataFrame:
    """Per row of the input: ``doc_id, size, source_size, target, taken``."""
    each = mix.taken.groupBy("sid", "bucket", "nth").agg(F.sum("got").alias("taken"))
    rows = mix.rows.join(each, ["sid", "bucket", "nth"], "left")
    rows = rows.join(mix.sources.select("sid", "source_size", "target"), "sid")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
