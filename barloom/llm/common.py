"""Scratch tables and column helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    On a local master (tests on one machine) a temporary folder is made where
    the setting is absent, and kept for the session; elsewhere that is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        told = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", told)
    return told


def run_dir(spark: SparkSession) -> str:
    """The folder in the shared one that holds this application's tables."""
    return f"{shared_dir(spark)}/barloom-{spark.conf.get('spark.app.id')}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete all tables that this application has written; results that still
    read them must be saved first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, never the work
    before the table.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(df: DataFrame) -> None:
    """Delete the folder of a table that ``written`` gave and nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0][: files[0].rindex("/")])
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text) -> F.Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def left_lookup(docs: DataFrame, found: DataFrame, also: list[str] | None = None) -> DataFrame:
    """``docs`` left-joined with ``found`` on doc_id (and the columns ``also``);
    rows without an id match nothing and are spread over all tasks."""
    none = F.col("doc_id") % 1  # zero, but no constant that the planner would take out of the join's keys
    lone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id() + 1).otherwise(none)
    left = docs.withColumn("__lone", lone).withColumn("__id", F.coalesce("doc_id", F.lit(0).cast("long")))
    right = found.withColumn("__lone", none).withColumnRenamed("doc_id", "__id")
    return left.join(right, ["__id", "__lone", *(also or [])], "left").drop("__id", "__lone")


def sums_before(rows: DataFrame, key: str, place: str, value: str, step: int = 4096) -> DataFrame:
    """``rows`` (one for each ``key`` and ``place``) with ``base``, the sum of
    ``value`` at smaller places of the key.  Places are taken in steps, so a task
    holds one step, or one number for each step of a key."""
    rows = rows.withColumn("__step", F.floor(F.col(place) / step))
    coarse = rows.groupBy(key, "__step").agg(F.sum(value).alias("__sum"))
    coarse = coarse.withColumn("__far", F.sum("__sum").over(Window.partitionBy(key).orderBy("__step")) - F.col("__sum")).drop("__sum")
    near = F.sum(value).over(Window.partitionBy(key, "__step").orderBy(place)) - F.col(value)
    return rows.withColumn("__near", near).join(coarse, [key, "__step"]).withColumn("base", F.col("__near") + F.col("__far")).drop("__step", "__near", "__far")
