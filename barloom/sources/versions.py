"""A table of bars in versions: readers see whole versions, writers touch few partitions.

Rows lie in partitions of a year and a bucket of symbols.  A change writes only the
partitions it touches, to a new folder, and then one small file that lists the
partitions of the new version; that file appears in one step, so a reader has the
version before or the one after and never half of both.  Data of old versions
stays until ``expire``.  The version files are the audit of all changes at the same
time: each has the counts of its run, taken while its rows were written.  A run
that fails leaves its start behind and no version.

One writer at a time; any number of readers.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from barloom.sources.bars import BAR

#: Buckets of symbols in a year.
BUCKETS = 8
COUNTS = ("received", "refused", "repeated", "inserted", "restated", "unchanged", "before", "after")


@dataclass(frozen=True)
class Version:
    """``parts`` maps a partition to its folder; ``applied`` a stream to its last batch."""

    number: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)
    rows: int = 0


def valid_bars(new: DataFrame) -> F.Column:
    """Bars that ingestion takes: a key, a positive close, and high >= low where both are there."""
    keyed = F.col("symbol").isNotNull() & F.col("date").isNotNull()
    return keyed & F.coalesce(F.col("close") > 0, F.lit(False)) & ~F.isnan("close") & F.coalesce(F.col("high") >= F.col("low"), F.lit(True))


class BarStore:
    """Bars under ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str) -> list[str]:
        where = self._path(f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in self._files.listStatus(where)) if self._files.exists(where) else []

    def _put(self, name: str, content: dict) -> None:
        """A file that appears whole: written beside its place, then renamed."""
        place, beside = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/new/{uuid.uuid4().hex}")
        out = self._files.create(beside, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        self._files.mkdirs(place.getParent())
        if self._files.exists(place) or not self._files.rename(beside, place):
            raise RuntimeError(f"{name} is there already: another writer?")

    def _get(self, name: str) -> dict:
        stream = self._files.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def version(self, number: int | None = None) -> Version:
        """The newest version, or an older one."""
        names = [n for n in self._names("versions") if n.endswith(".json")]
        if number == 0 or (number is None and not names):
            return Version()
        found = self._get(f"versions/{number:010d}.json" if number else f"versions/{names[-1]}")
        return Version(found["version"], found["parts"], found["applied"], found["after"])

    def _paths(self, version: Version, years: tuple[int, int] | None = None) -> list[str]:
        inside = lambda part: years is None or years[0] <= int(part.split("-")[0]) <= years[1]
        return [path for part, path in sorted(version.parts.items()) if inside(part)]

    def read(self, number: int | None = None, years: tuple[int, int] | None = None) -> DataFrame:
        """The bars of a version (the newest), of all years or from ``years[0]`` to ``years[1]``;
        partitions of other years are not listed."""
        paths = self._paths(self.version(number), years)
        if not paths:
            return self.spark.createDataFrame([], BAR)
        return self.spark.read.schema(BAR).parquet(*[f"{self.root}/{p}" for p in paths])

    def upsert(self, batch: DataFrame, stream: str = "backfill", batch_id: int | None = None, restate: bool = True) -> Version:
        """Add the batch's bars that are missing; with ``restate`` stored ones take its
        adjusted close, and nothing else of theirs changes.

        Of several bars for one key the last in the order of their prices counts, the
        others are ``repeated``.  A batch of ``stream`` that a version has already
        (``batch_id``) changes nothing.  The batch is read once, cleaned and staged by partition; the
        staged rows then meet the touched partitions.
        """
        base = self.version()
        if batch_id is not None and base.applied.get(stream, -1) >= batch_id:
            return base
        number = base.number + 1
        run = {"version": number, "stream": stream, "batch": -1 if batch_id is None else batch_id, "started": time.time()}
        self._files.delete(self._path(f"{self.root}/runs/{number:010d}.json"), False)  # of a run that failed
        self._put(f"runs/{number:010d}.json", run)

        got, put = Observation(), Observation()
        ok = valid_bars(batch)
        seen = batch.observe(got, F.count(F.lit(1)).alias("received"), F.count(F.when(~ok, 1)).alias("refused"))
        order = F.struct("close", "open", "high", "low", "adjusted_close", "volume")
        others = [c for c in BAR.fieldNames() if c not in ("symbol", "date")]
        new = seen.where(ok).groupBy("symbol", "date").agg(F.max_by(F.struct(*others), order).alias("bar")).select("symbol", "date", "bar.*")
        new = new.withColumns(
            {c: F.coalesce(c, F.lit(0.0)) for c in ("open", "high", "low")} | {"volume": F.coalesce("volume", F.lit(0).cast("long"))}
        )
        new = new.withColumn("adjusted_close", F.coalesce("adjusted_close", "close")).select(*BAR.fieldNames())
        part = F.concat_ws("-", F.year("date"), F.pmod(F.xxhash64("symbol"), F.lit(BUCKETS)))
        staged, target = f"staged/{uuid.uuid4().hex}", f"data/{uuid.uuid4().hex}"
        new.withColumn("part", part).hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.root}/{staged}")
        touched = [n.removeprefix("part=") for n in self._names(staged) if n.startswith("part=")]
        counts = dict(got.get) | {"inserted": 0, "restated": 0, "unchanged": 0, "before": base.rows}

        if touched:
            fresh = self.spark.read.schema(BAR).parquet(f"{self.root}/{staged}").select(*BAR.fieldNames())
            old = [base.parts[p] for p in touched if p in base.parts]
            stored = self.spark.read.schema(BAR).parquet(*[f"{self.root}/{p}" for p in old]) if old else self.spark.createDataFrame([], BAR)
            both = stored.withColumn("had", F.lit(True)).alias("a").join(
                fresh.withColumn("has", F.lit(True)).alias("b"), ["symbol", "date"], "full_outer"
            )
            is_new, meets = F.col("had").isNull(), F.col("had") & F.col("has")
            changed = F.coalesce(meets & F.lit(restate) & ~F.col("a.adjusted_close").eqNullSafe(F.col("b.adjusted_close")), F.lit(False))
            pick = {c: F.when(is_new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) for c in others}
            pick["adjusted_close"] = F.when(changed | is_new, F.col("b.adjusted_close")).otherwise(F.col("a.adjusted_close"))
            rows = both.select(
                "symbol", "date", *[pick[c].alias(c) for c in others], is_new.alias("is_new"), changed.alias("changed"),
                F.coalesce(meets, F.lit(False)).alias("meets")
            )
            rows = rows.observe(
                put,
                *[
                    F.count(F.when(F.expr(x), 1)).alias(n) for n,
                    x in (("inserted", "is_new"), ("restated", "changed"), ("unchanged", "meets and not changed"))
                ]
            )
            rows = rows.select(*BAR.fieldNames()).withColumn("part", part).hint("rebalance", "part")
            rows.write.partitionBy("part").parquet(f"{self.root}/{target}")
            counts |= dict(put.get)
        self._files.delete(self._path(f"{self.root}/{staged}"), True)

        counts["repeated"] = counts["received"] - counts["refused"] - counts["inserted"] - counts["restated"] - counts["unchanged"]
        counts["after"] = base.rows + counts["inserted"]
        parts = base.parts | {p: f"{target}/part={p}" for p in touched}
        applied = base.applied if batch_id is None else base.applied | {stream: batch_id}
        self._put(f"versions/{number:010d}.json", run | counts | {"finished": time.time(), "parts": parts, "applied": applied})
        return Version(number, parts, applied, counts["after"])

    def runs(self) -> DataFrame:
        """The audit: a row for each run with its counts; ``status`` is success, or running
        for one that has not made its version (yet)."""
        named = ", ".join(f"{c} long" for c in COUNTS)
        began = "version long, stream string, batch long, started double"
        if not self._names("runs"):
            return self.spark.createDataFrame([], f"{began}, {named}, finished double, status string")
        runs = self.spark.read.schema(began).json(f"{self.root}/runs")
        if not self._names("versions"):
            done = self.spark.createDataFrame([], f"version long, {named}, finished double")
        else:
            done = self.spark.read.schema(f"version long, {named}, finished double").json(f"{self.root}/versions")
        return runs.join(done, "version", "left").withColumn("status", F.when(F.col("finished").isNull(), "running").otherwise("success"))

    def expire(self, keep: int = 1) -> list[str]:
        """Delete data folders that none of the last ``keep`` versions lists, and give their names."""
        newest = self.version().number
        used = {path.split("/part=")[0] for n in range(max(1, newest - keep + 1), newest + 1) for path in self.version(n).parts.values()}
        gone = [f"data/{n}" for n in self._names("data") if f"data/{n}" not in used]
        for name in gone:
            self._files.delete(self._path(f"{self.root}/{name}"), True)
        return gone
