"""Streams of events: hourly bars, deduplicated ingestion, sessions, averages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.operators import tails
from barloom.sources.bars import cents
from barloom.sources.versions import BarStore

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of the table ``name`` in ``folder``, a file or a folder of files.

    Without ``files_per_batch`` the files that are there make one batch, so that
    a watermark drops none of them whatever order their events are in.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    reader = spark.readStream.schema(EVENT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if files.getFileStatus(where).isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def hourly_bars(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Tumbling hourly bars; events later than the watermark are left out."""
    e = events.withWatermark("ts", late).select("ts", "event_id", F.col("event_type").alias("symbol"), cents(F.col("value") * 100).alias("price"))
    key = F.struct("ts", "event_id")
    g = e.groupBy("symbol", F.window("ts", "1 hour").alias("w")).agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"),
        F.count("*").alias("volume")
    )
    return g.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def unique_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once, with state no older than the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = events.withWatermark("ts", late)
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", F.round("total", 6).alias("total"))


def running_average(events: DataFrame, n: int = 20) -> DataFrame:
    """An exponential average of each event type's values that goes on from batch
    to batch; rows of a batch are taken in the order of time and id."""
    weight = 2 / (n + 1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        level, seen = state.get if state.exists else (None, 0)
        for v in f["value"]:
            level = v if level is None else level + weight * (v - level)
            seen += 1
        state.update((float(level), int(seen)))
        yield pd.DataFrame({"symbol": [key[0]], "average": [float(level)], "n": [int(seen)]})

    return events.groupBy("event_type").applyInPandasWithState(
        step, "symbol string, average double, n long", "level double, seen long", "update", "NoTimeout"
    )


@contextmanager
def few_keys(spark: SparkSession, keys: int) -> Iterator[None]:
    """For streams started inside: state in no more partitions than there are keys.  A
    stream keeps the number that it started with, and each one costs a store and a
    Python worker in every batch, so few keys shouldn't be dealt over hundreds."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), max(keys, 1))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Take in all there is, append the results as Parquet, and read them."""
    path = f"{folder}/{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def monthly_closes(bars: DataFrame) -> DataFrame:
    """Each symbol's last close of a month so far, its date, and the number of bars, from a stream of
    bars in update mode.  State is a row for each symbol and month."""
    month = F.trunc("date", "month").alias("month")
    return bars.groupBy("symbol", month).agg(F.max_by("close", "date").alias("close"), F.max("date").alias("last"), F.count("*").alias("n"))


def months_so_far(closes: DataFrame) -> DataFrame:
    """Returns of months on the month just before (null where that is missing), with ``is_complete``: a
    later month of the symbol has begun, or the last bar is at most four days before the
    month's last weekday.  Only complete months have a ``rank`` among the symbol's returns."""
    order = Window.partitionBy("symbol").orderBy("month")
    end = F.last_day("month")
    weekday = F.dayofweek(end)  # 1 is Sunday
    last_weekday = F.when(weekday == 1, F.date_sub(end, 2)).when(weekday == 7, F.date_sub(end, 1)).otherwise(end)
    whole = F.lead("month").over(order).isNotNull() | (F.col("last") >= F.date_sub(last_weekday, 4))
    df = closes.select("*", whole.alias("is_complete"), F.lag("close").over(order).alias("before"), F.lag("month").over(order).alias("month_before"))
    r = F.when(F.col("month_before") == F.add_months("month", -1), F.col("close") / F.col("before") - 1)
    df = df.withColumn("r", r).withColumn("counts", F.col("is_complete") & F.col("r").isNotNull())
    rank = F.rank().over(Window.partitionBy("symbol", "counts").orderBy(F.desc("r"))).cast("long")
    return df.select(
        "symbol", "month", "close", "n", "is_complete", F.round(F.col("r") * 100, 6).alias("return_percent"),
        F.when(F.col("counts"), rank).alias("rank")
    )


def running_indicators(bars: DataFrame) -> DataFrame:
    """EMA, RSI, ATR and MACD of each symbol's newest bar, from a stream of bars in the order of
    their dates: ``symbol, date, i, close`` and ``tails.VIEW``.  The state of a symbol is that
    of ``tails``: a dozen numbers, whatever its history."""
    numbers = tails.NUMBERS

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict(zip(["i", *numbers], state.get)) if state.exists else {"i": 0} | dict.fromkeys(numbers)
        w = tails.walk(pd.concat(list(frames)), held)
        last = w.iloc[-1]
        state.update((int(last["i"]), *(float(last[x]) for x in numbers)))
        yield pd.concat([w[["date", "i", "close"]], tails.view(w)], axis=1).tail(1).assign(symbol=key[0])[["symbol", "date", "i", "close", *tails.VIEW]]

    out = f"symbol string, date date, i long, close double, {', '.join(f'{x} double' for x in tails.VIEW)}"
    kept = f"i long, {', '.join(f'{x} double' for x in numbers)}"
    return bars.groupBy("symbol").applyInPandasWithState(step, out, kept, "update", "NoTimeout")


def run_updates(stream: DataFrame, folder: str, key: str | list[str], order: str) -> DataFrame:
    """Take in all there is in update mode; of each ``key`` the row with the greatest
    ``order``.  A batch's rows go to a folder of their own, which a replay writes anew."""
    path = f"{folder}/{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    q = stream.writeStream.foreachBatch(put).outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{path}/state").start()
    q.awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
    keys = [key] if isinstance(key, str) else key
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("row")).select(*keys, "row.*")


def restating_sink(stream: DataFrame, root: str, checkpoint: str, name: str = "corrections", restate: bool = True) -> BarStore:
    """Bars from a stream into a store of versions: missing ones are added, stored ones
    take the adjusted close of late corrections.  A batch makes one version; one that
    is replayed after a failure makes none again."""
    store = BarStore(stream.sparkSession, root)

    def put(batch: DataFrame, number: int) -> None:
        store.upsert(batch, name, number, restate)

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return store


def in_order(rows: DataFrame, folder: str, column: str, cuts: list) -> DataFrame:
    """``rows`` as a stream of files, a batch each: those below the first cut of ``column``,
    then up to the next, and so on.  Files are written one after the other, since a
    stream takes them by their time."""
    edges = [None, *cuts, None]
    for lo, hi in zip(edges[:-1], edges[1:]):
        inside = F.lit(True) if lo is None else F.col(column) >= F.lit(lo)
        inside = inside if hi is None else inside & (F.col(column) < F.lit(hi))
        rows.where(inside).coalesce(1).write.mode("append").parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def merge_bars(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Ingest bars from a stream into Parquet: each batch adds what isn't stored."""
    from barloom.operators.scans import ingest

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            stored = spark.read.schema(batch.schema).parquet(path)
        except Exception as error:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            stored = spark.createDataFrame([], batch.schema)
        ingest(stored, batch).write.mode("append").parquet(path)

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
