"""Schemas, and price bars made from the transaction tables.

A bar has one row for each symbol and date: ``symbol, date, open, high, low,
close, adjusted_close, volume``.  Prices have two decimals, so sums of them are
exact enough to compare across engines.

Bars are made once for each version of the trades and kept as a table in buckets
of the symbol, each one file in date order: work by symbol then needs neither a
shuffle nor a sort.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.sources.scratch import shared_dir

BAR = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adjusted_close")]
    + [T.StructField("volume", T.LongType())]
)

#: Closes before this date are adjusted by this factor.
SPLIT_DATE, SPLIT_FACTOR = "1998-06-01", 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
#: So many days of all symbols are broadcast to the trades (two short rows each).
FEW_DAYS = 200_000
#: Spark's own ``spark.shuffle.sort.bypassMergeThreshold``.
AS_THEY_COME = 200


@contextmanager
def written_as_they_come(spark: SparkSession) -> Iterator[None]:
    """For shuffles of all trades that are planned and run inside: in no more partitions than
    those up to which a task writes its rows as they come.  Beyond, it first gathers and
    sorts all rows that it has read, so its memory grows with its part of the input."""
    most = max(AS_THEY_COME, int(spark.conf.get("spark.shuffle.sort.bypassMergeThreshold", str(AS_THEY_COME))))
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    before = {x: n for x in names if (n := spark.conf.get(x, None)) and int(n) > most}
    try:
        for x in before:
            spark.conf.set(x, str(most))
        yield
    finally:
        for x, n in before.items():
            spark.conf.set(x, n)


def _bars(trades: DataFrame, named: Callable[[DataFrame], DataFrame], kept: Callable[[Callable[[], DataFrame]], DataFrame]) -> DataFrame:
    """From trades (``date, price, quantity`` and ``LINE_KEY``), to which ``named`` adds
    their ``symbol``, ordered in a day by the key.

    Spark sorts all trades to find the least of a key of several columns, but keeps sums
    and extremes of plain columns in a hash table of days.  So the first pass finds each
    day's extremes of the key's first column too, and only trades that have one of them
    are ordered by the whole key.  ``kept`` stores the days in between: by their number
    they are broadcast to the trades or hashed by partition, whatever Spark's threshold
    is, as a merge join would sort all trades."""
    lead = F.col(LINE_KEY[0])
    days = kept(lambda: named(trades).groupBy("symbol", "date").agg(
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.sum("quantity").cast("long").alias("volume"),
        F.when(F.count(lead) == F.count("*"), F.min(lead)).alias("first"),  # null comes first
        F.max(lead).alias("last"),
    ))
    ends = days.select(F.col("date").alias("__date"), F.explode(F.array("first", "last")).alias("__lead"))
    ends = ends.hint("broadcast" if days.count() <= FEW_DAYS else "shuffle_hash")
    near = trades.join(ends, F.col("date").eqNullSafe(F.col("__date")) & lead.eqNullSafe(F.col("__lead")), "left_semi")
    key = F.struct(*LINE_KEY)
    found = named(near).groupBy(F.col("symbol").alias("__symbol"), F.col("date").alias("__date")).agg(
        F.min_by("price", key).alias("open"), F.max_by("price", key).alias("close")
    )
    same = F.col("symbol").eqNullSafe(F.col("__symbol")) & F.col("date").eqNullSafe(F.col("__date"))
    factor = F.when(F.col("date") < F.lit(SPLIT_DATE).cast("date"), SPLIT_FACTOR).otherwise(1.0)
    return days.join(found, same).withColumn("adjusted_close", F.round(F.col("close") * factor, 4)).select(*BAR.fieldNames())


def cents(amount: Column) -> Column:
    return (10000 + F.floor(amount)) / 100.0


#: Tables of bars that this process has made, by application, source and version.
_STORE: dict[tuple, str] = {}


def _version(spark: SparkSession, path: str) -> tuple:
    """Time and size of a file, or of all files in a folder and its folders."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(where, True)
    found = []
    while files.hasNext():
        x = files.next()
        found.append((x.getPath().toString(), x.getModificationTime(), x.getLen()))
    return tuple(sorted(found))


def stored(spark: SparkSession, name: str, sources: list[str], make, bucketed: bool = True, by_year: bool = False, inside=nullcontext) -> DataFrame:
    """The rows that ``make()`` gives, from a table (in buckets of the symbol; ``by_year``:
    in partitions of ``year`` too) if ``sources`` are what they were when it was written.
    Else it is made and written under the context ``inside(spark)``."""
    key = (spark.conf.get("spark.app.id"), name, *sources, *(_version(spark, x) for x in sources))
    if key not in _STORE or not spark.catalog.tableExists(_STORE[key]):
        made, n = f"barloom_{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
        with inside(spark):
            rows = make()
            if by_year:
                writer = rows.withColumn("year", F.year("date")).repartition(n, "symbol").write.partitionBy("year").bucketBy(n, "symbol").sortBy("symbol", "date")
            else:
                writer = rows.repartition(n, "symbol").write.bucketBy(n, "symbol").sortBy("symbol", "date") if bucketed else rows.write
            writer.format("parquet").option("path", f"{shared_dir(spark)}/{made}").saveAsTable(made)
        _STORE[key] = made
    # one file a bucket: the scan may tell Spark that its rows are sorted
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    return spark.table(_STORE[key])


def drop_stored(spark: SparkSession) -> int:
    """Drop the tables of this application, with their files, and the setting that reading
    them needs; gives their number."""
    mine = [k for k in _STORE if k[0] == spark.conf.get("spark.app.id")]
    for key in mine:
        name = _STORE.pop(key)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
    return len(mine)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the six return-flag and line-status symbols (the fund universe)."""
    return stored(spark, "bars", [f"{sf_dir}/lineitem.parquet"], lambda: _fund_bars(spark, sf_dir), inside=written_as_they_come)


def bars_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bars in partitions of ``year``, for reads of a range of dates."""
    return stored(spark, "years", [f"{sf_dir}/lineitem.parquet"], lambda: bars(spark, sf_dir), by_year=True)


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"), cents(F.col("l_extendedprice") / 10).alias("price"), F.col("l_quantity").alias("quantity"),
        "l_returnflag", "l_linestatus", *LINE_KEY
    )


def _fund_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda trades: trades.withColumn("symbol", F.concat("l_returnflag", "l_linestatus"))
    kept = lambda make: stored(spark, "bar_days", [f"{sf_dir}/lineitem.parquet"], make, bucketed=False)
    return _bars(_trades(spark, sf_dir), named, kept)


def bars_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the part brands (the stock universe)."""
    return stored(spark, "stocks", [f"{sf_dir}/{x}.parquet" for x in ("lineitem", "part")], lambda: _stock_bars(spark, sf_dir), inside=written_as_they_come)


def _stock_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a hash table of each partition's parts: a merge join would sort all trades by part
    brand = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol")).hint("shuffle_hash")
    kept = lambda make: stored(spark, "stock_days", [f"{sf_dir}/{x}.parquet" for x in ("lineitem", "part")], make, bucketed=False)
    return _bars(_trades(spark, sf_dir), lambda trades: trades.join(brand, "l_partkey"), kept)


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event types: ``symbol, ts, open, high, low, close, volume``."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("hour"), cents(F.col("value") * 100).alias("price"),
        F.struct("ts", "event_id").alias("k")
    )
    return e.groupBy("symbol", F.col("hour").alias("ts")).agg(
        F.min_by("price", "k").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "k").alias("close"), F.count("*").alias("volume")
    )


# The same tables for DuckDB.
_KEY = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
_DAY = f"""
    arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close,
    round(arg_max(price, k) * CASE WHEN date < DATE '{SPLIT_DATE}' THEN {SPLIT_FACTOR} ELSE 1.0 END, 4) AS adjusted_close,
    CAST(sum(quantity) AS BIGINT) AS volume"""
_PRICE = "CAST((10000 + floor(l_extendedprice / 10)) / 100.0 AS DOUBLE) AS price"
BARS_SQL = f"""bars AS (SELECT symbol, date, {_DAY} FROM (
    SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date, {_PRICE},
        l_quantity AS quantity, {_KEY} AS k FROM lineitem) GROUP BY symbol, date)"""
STOCKS_SQL = f"""stocks AS (SELECT symbol, date, {_DAY} FROM (
    SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, {_PRICE},
        l_quantity AS quantity, {_KEY} AS k FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY symbol, date)"""
HOURS_SQL = """hours AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(price, k) AS open,
    max(price) AS high, min(price) AS low, arg_max(price, k) AS close, count(*) AS volume FROM (
    SELECT *, CAST((10000 + floor(value * 100)) / 100.0 AS DOUBLE) AS price, row(ts, event_id) AS k FROM events)
    GROUP BY event_type, date_trunc('hour', ts))"""
