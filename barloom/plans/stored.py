"""Queries over stored versions, streams in several batches and exchange sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import snapshots as sn
from barloom.operators.tails import VIEW
from barloom.sources.bars import bars, bars_stock, cents, table
from barloom.sources.markup import index_members, page_tables
from barloom.sources.scratch import shared_dir
from barloom.sources.versions import COUNTS, BarStore
from barloom.streaming import bars as st
from barloom.streaming import sessions as ss

#: The store begins with the bars before this date; corrections come in four files.
STORED, CUTS = "2000-01-01", ["1999-07-01", "2000-01-01", "2001-01-01"]


def corrected(spark: SparkSession, sf_dir: str, restate: bool = True) -> BarStore:
    """A store of the older bars after a stream of corrections to the newer half of
    them and of later bars: adjusted closes are halved, closes of each 13th are
    missing, bars of Decembers come twice."""
    b, folder = bars(spark, sf_dir), f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    store = BarStore(spark, f"{folder}/store")
    store.upsert(b.where(F.col("date") < STORED))
    late = b.where(F.col("date") >= "1999-01-01").withColumn("adjusted_close", F.round(F.col("close") / 2, 6))
    late = late.withColumn("close", F.when(F.dayofmonth("date") != 13, F.col("close")))
    late = late.unionByName(late.where(F.month("date") == 12))
    stream = st.in_order(late, f"{folder}/landing", "date", CUTS)
    return st.restating_sink(stream, f"{folder}/store", f"{folder}/state", restate=restate)


def restated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrected(spark, sf_dir).read()


def ingest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrected(spark, sf_dir).runs().select("version", "stream", "batch", "status", *COUNTS)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("id"), cents(F.col("value") * 100).alias("price")
    )


#: Event types, and symbols of the funds, are no more than this.
KEYS = 8
#: Days of the events' month that begin a new file of the stream.
SLICES = ["2024-01-08", "2024-01-15 12:00:00", "2024-01-24"]


def averages_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    e = events(spark, sf_dir).select(*[c.split()[0] for c in st.EVENT.split(", ")])
    stream = st.in_order(e, f"{folder}/{uuid.uuid4().hex}", "ts", SLICES)
    with st.few_keys(spark, KEYS):
        out = st.run_updates(st.running_average(stream), folder, "symbol", "n")
    return out.select("symbol", F.round("average", 6).alias("average"), "n")


#: The watermark's delay, under which the last session of the test events is still open.
LATE = "4 hours"


def closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    stream = st.in_order(_trades(spark, sf_dir), f"{folder}/{uuid.uuid4().hex}", "ts", SLICES)
    with ss.timers(spark), st.few_keys(spark, KEYS):
        return st.run_to_table(ss.closed_bars(stream, LATE), folder)


#: Exchanges with their zones and hours on the local clock.
EXCHANGES = [
    ("NEWYORK", "America/New_York", "09:30", "16:00"), ("LONDON", "Europe/London", "08:00", "16:30"), ("TOKYO", "Asia/Tokyo", "09:00", "15:00")
]
HOLIDAYS = [("NEWYORK", "2024-03-29"), ("LONDON", "2024-03-29"), ("TOKYO", "2024-03-20"), ("TOKYO", "2024-11-04")]
#: Days that move the events' month over the clock changes of spring and autumn.
SPRING, AUTUMN = 65, 290


def session_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of three exchanges over both clock changes; a trade's exchange and
    season follow from its id."""
    t = _trades(spark, sf_dir)
    exchange = F.element_at(F.array(*[F.lit(e[0]) for e in EXCHANGES]), (F.col("id") % 3 + 1).cast("int"))
    shift = F.when(F.floor(F.col("id") / 3) % 2 == 0, SPRING).otherwise(AUTUMN)
    t = t.withColumn("exchange", exchange).withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + shift * 86_400_000_000))
    exchanges = spark.createDataFrame(EXCHANGES, "exchange string, zone string, opens string, closes string")
    off = spark.createDataFrame(HOLIDAYS, "exchange string, date string").withColumn("date", F.col("date").cast("date"))
    found = ss.intraday_bars(t, ss.calendar(exchanges, "2024-03-01", "2024-11-30", off))
    return found.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def planted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; those with an id divisible by 3 end with a table of the nations of
    one region, sectors in cells over several rows and some names over two columns.
    Of those divisible by 11 too the table never ends, nor do its rows and cells."""
    n = table(spark, sf_dir, "nation").withColumn("sector", F.col("n_nationkey") % 2)
    group, one = Window.partitionBy("n_regionkey", "sector"), Window.partitionBy("n_regionkey", "sector").orderBy("n_nationkey")
    n = n.withColumn("first", F.row_number().over(one) == 1).withColumn("size", F.count("*").over(group))
    name = F.concat("n_name", F.lit(" &amp; Co"))
    security = F.when(
        F.col("n_nationkey") % 3 == 0, F.concat(F.lit('<td colspan="2">'), name, F.lit("</td>"))
    ).otherwise(F.concat(F.lit("<td>"), name, F.lit("</td><td>filed</td>")))
    sector = F.when(F.col("first"), F.format_string('<td rowspan="%d">Sector %d</td>', "size", "sector")).otherwise("")
    row = F.concat(
        F.lit("<tr><td><a href='/q'> "), F.lower(F.substring("n_name", 1, 4)), F.lit("."), F.col("n_nationkey").cast("string"), F.lit("</a></td>"),
        security, sector, F.lit("<td>"), "n_name", F.lit(" works</td></tr>")
    )
    rows = n.select("n_regionkey", F.struct("sector", "n_nationkey", row.alias("row")).alias("r"))
    head = "<table class='wide'><tr><th>Symbol</th><th>Security</th><th>Filings</th><th>GICS Sector</th><th>GICS Sub-Industry</th></tr>"
    body = F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["row"]), "")
    regions = rows.groupBy(F.col("n_regionkey").alias("region")).agg(F.concat(F.lit(head), body, F.lit("</table>")).alias("markup"))
    pages = table(spark, sf_dir, "pages").withColumn("region", F.col("page_id") % 5).join(regions, "region", "left")
    markup = F.when(F.col("page_id") % 11 == 0, F.regexp_replace("markup", "</(table|tr|td)>", "")).otherwise(F.col("markup"))
    return pages.select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat("html", markup)).otherwise(F.col("html")).alias("html"))


def members_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_members(page_tables(planted_pages(spark, sf_dir)))


def page_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_tables(planted_pages(spark, sf_dir))
    return found.select("page_id", F.size("rows").alias("n_rows"), "n_tables", "n_unclosed", "n_stray", "n_bad_spans")


#: Fixed values: (valid, recorded) of three reads.
MOMENTS = [("1995-06-30", "1995-06-30 12:00:00"), ("1996-12-31", "1998-01-01 00:00:00"), ("1998-09-30", "1996-03-31 09:00:00")]


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-time facts of each stock and quarter: recorded some weeks later, corrected
    after four months where the quarter's days allow, and failing now and then."""
    b = bars_stock(spark, sf_dir)
    q = b.groupBy("symbol", F.trunc("date", "quarter").alias("q")).agg((F.floor(F.max("close")) / 50.0).alias("eps"), F.count("*").alias("n_bars"))
    q = q.withColumn("valid_from", F.last_day(F.add_months("q", 2)))
    lag = (20 + F.crc32(F.col("symbol").cast("binary")) % 40).cast("int")
    at = lambda days: F.date_add("valid_from", days).cast("timestamp")
    failed = (F.year("q") + F.month("q")) % 5 == 0
    first = q.select(
        "symbol", "valid_from", at(lag).alias("recorded_at"), (~failed).alias("ok"), F.when(~failed, F.col("eps")).alias("eps"),
        F.when(~failed, F.col("n_bars")).alias("n_bars")
    )
    again = q.where("n_bars % 3 = 0").select(
        "symbol", "valid_from", at(lag + 120).alias("recorded_at"), F.lit(True).alias("ok"), (F.col("eps") * 2).alias("eps"), "n_bars"
    )
    return first.unionByName(again)


_SEEN = ["valid_from", "recorded_at", "eps", "n_bars"]


def snapshots_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sn.as_of(snapshots(spark, sf_dir), MOMENTS)
    return found.select("symbol", "moment", *_SEEN[:1], F.date_format("recorded_at", "yyyy-MM-dd").alias("recorded_at"), "eps", "n_bars")


def snapshots_for_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of a stock at the close of each of its bars."""
    asks = bars_stock(spark, sf_dir).select("symbol", F.col("date").alias("valid"), F.col("date").cast("timestamp").alias("recorded"))
    found = sn.as_of_join(asks, snapshots(spark, sf_dir))
    return found.select("symbol", "valid", *_SEEN[:1], F.date_format("recorded_at", "yyyy-MM-dd").alias("recorded_at"), "eps", "n_bars")


def snapshots_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sn.latest(snapshots(spark, sf_dir)).select(
        "symbol", "valid_from", F.date_format("recorded_at", "yyyy-MM-dd").alias("recorded_at"), "eps", "n_bars"
    )


def snapshot_refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sn.refresh_counts(snapshots(spark, sf_dir), F.date_format("recorded_at", "yyyy-MM"))


#: Dates that begin a new file of bars; the last month of the stream is cut short.
BAR_FILES, STREAM_END = ["1994-03-10", "1996-07-17", "1997-12-31"], "1998-08-12"


def _bar_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).where(F.col("date") <= STREAM_END)
    return st.in_order(rows, f"{shared_dir(spark)}/{uuid.uuid4().hex}", "date", BAR_FILES)


def stream_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    with st.few_keys(spark, KEYS):
        closes = st.run_updates(st.monthly_closes(_bar_stream(spark, sf_dir)), shared_dir(spark), ["symbol", "month"], "n")
    return st.months_so_far(closes)


def stream_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    with st.few_keys(spark, KEYS):
        found = st.run_updates(st.running_indicators(_bar_stream(spark, sf_dir)), shared_dir(spark), "symbol", "i")
    return found.select("symbol", "date", "i", "close", *[F.round(x, 6).alias(x) for x in VIEW])


QUERIES = {
    "stream_months": stream_months,
    "stream_indicators": stream_indicators,
    "members_from_pages": members_from_pages,
    "page_table_counts": page_table_counts,
    "snapshots_as_of": snapshots_as_of,
    "snapshots_for_bars": snapshots_for_bars,
    "snapshots_latest": snapshots_latest,
    "snapshot_refreshes": snapshot_refreshes,
    "stream_restatement": restated,
    "ingest_runs": ingest_runs,
    "stream_ema_batches": averages_in_batches,
    "stream_closed_sessions": closed_sessions,
    "session_hours": session_hours,
}
