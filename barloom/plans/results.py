"""Stored results, found by what they depend on.

A result is kept as a table under a key of its name, the newest bar's date and a
fingerprint of its settings.  Settings that say the same have the same fingerprint
in whatever order or type of sequence; a newer bar changes the key, so stale
results are missed and never cleared by hand.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(value: Any) -> Any:
    """Plain JSON of a setting: keys sorted, sets sorted, tuples as lists, dates as text;
    a whole float is the integer."""
    if isinstance(value, Mapping):
        return {str(k): canonical(value[k]) for k in sorted(value, key=str)}
    if isinstance(value, (set, frozenset)):
        return sorted((canonical(v) for v in value), key=json.dumps)
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    raise TypeError(f"a setting of type {type(value).__name__} has no fingerprint")


def fingerprint(settings: Mapping[str, Any]) -> str:
    text = json.dumps(canonical(settings), separators=(",", ":"), sort_keys=True, ensure_ascii=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


class Results:
    """Results under ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.hits = self.misses = 0

    def key(self, name: str, newest: date | str, settings: Mapping[str, Any]) -> str:
        return f"{name}/{newest}/{fingerprint(settings)}"

    def _age(self, key: str) -> float | None:
        done = self._path(f"{self.root}/{key}/_SUCCESS")
        if not self._files.exists(done):
            return None
        return time.time() - self._files.getFileStatus(done).getModificationTime() / 1000

    def get_or_compute(
        self, name: str, newest: date | str, settings: Mapping[str, Any], make: Callable[[], DataFrame], most_age: float = 86400.0
    ) -> DataFrame:
        """The stored result if it is there and no older than ``most_age`` seconds, else that of
        ``make()``, written beside its place and then moved, so no reader sees a part of it.
        What fails isn't stored."""
        key = self.key(name, newest, settings)
        age = self._age(key)
        if age is not None and age <= most_age:
            self.hits += 1
            return self.spark.read.parquet(f"{self.root}/{key}")
        self.misses += 1
        beside, place = f"{self.root}/new/{uuid.uuid4().hex}", self._path(f"{self.root}/{key}")
        made = make()
        made.write.parquet(beside)
        if age is not None:
            self._files.delete(place, True)
        self._files.mkdirs(place.getParent())
        if self._files.exists(place) or not self._files.rename(self._path(beside), place):
            return self.spark.read.schema(made.schema).parquet(beside)  # another session was first
        return self.spark.read.schema(made.schema).parquet(f"{self.root}/{key}")

    def drop(self, name: str, newest: date | str | None = None) -> None:
        """Forget the results of a name, or of one newest date."""
        self._files.delete(self._path(f"{self.root}/{name}" + (f"/{newest}" if newest else "")), True)


def newest_date(bars: DataFrame) -> str:
    """The date of the newest bar, as the version of all results made from them."""
    return str(bars.agg(F.max("date")).first()[0])
