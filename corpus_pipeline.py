"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept: quality classifier, line dedup, SimHash near-dedup, mixing sources to
target weights, best-fit packing.  All but the last return the columns of
``documents``; ``run`` writes each result as Parquet and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.classifier import held_out, score_quality, train_quality_model
from barloom.llm.common import WORD, table, word_count, written
from barloom.llm.linededup import line_dedup
from barloom.llm.mixing import mix_sources
from barloom.llm.neardup import near_duplicate_groups
from barloom.llm.packing import best_fit_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    raw = table(spark, sf_dir, "documents")
    model = train_quality_model(raw, table(spark, sf_dir, "labels").where(~held_out()))
    judged = score_quality(docs, model, keep=COLUMNS)
    return judged.where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in one of them."""
    out = line_dedup(docs, keep=["lang", "source"])
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or
    more) the row of the smallest doc_id stays; groups are of texts, so an id with
    several texts may stay with some of them.  Rows without an id belong to no group and stay."""
    first = near_duplicate_groups(docs).where("kept").select("doc_id", "version").distinct()
    told = docs.withColumn("version", F.xxhash64(F.col("text").cast("string")))
    kept = told.join(first, ["doc_id", "version"], "left_semi").groupBy("doc_id", "version").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return kept.unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document once for each pass that
    takes it; where a target ends inside one, its first words.

    Rows without an id or with the same one are told apart by a hash of their
    contents, beside the id and never in its place.
    """
    docs = docs.withColumn("mark", F.xxhash64("text", "lang", "source")).withColumn("id", F.coalesce("doc_id", F.lit(0).cast("long"))).withColumn("lone", F.col("doc_id").isNull())
    mix = mix_sources(docs.select("doc_id", "text", "source", "mark"), mark=F.col("mark"))
    passes = mix.taken.join(mix.rows, ["sid", "bucket", "nth"])
    passes = passes.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNull().alias("lone"), "mark", "size", "got")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("got").cast("int")), " ")
    key = ["id", "lone", "mark"]
    out = docs.dropDuplicates(key).join(passes, key).withColumn("text", F.when(F.col("got") < F.col("size"), cut).otherwise(F.col("text")))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: the bin, its length, and each piece's place in it, in words."""
    return best_fit_packing(docs.select("doc_id", word_count("text").alias("length")))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("source_mixing", mixing),
    ("best_fit_packing", packing),
]

#: A trained classifier and greedy packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
