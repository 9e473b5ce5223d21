"""Rows alike in every column, rows without an id, and very large ids."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barloom.llm.common import left_lookup, sums_before
from barloom.llm.components import components
from barloom.llm.curves import nearest
from barloom.llm.dac import read_tokens, write_tokens
from barloom.llm.mixing import mix_sources, taken_words
from barloom.llm.packing import best_fit_packing
from barloom.llm.simhash import simhash_groups
from barloom.llm.tokencount import token_counts

from .test_simhash import check

ALIKE = 20_000


def alike(spark, doc_id):
    rows = spark.range(ALIKE).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit("one and the same text " * 5).alias("text"), F.lit("s").alias("source"))
    return rows.repartition(4)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_packing_deals_rows_alike(spark, doc_id):
    items = alike(spark, doc_id).withColumn("length", F.lit(100)).withColumn("bin", F.lit("clash")).withColumn("shard", F.lit(1))
    got = best_fit_packing(items, in_shard=1000)
    shards = got.groupBy(F.shiftright("bin", 32).alias("shard")).count().collect()
    assert sum(r["count"] for r in shards) == ALIKE and max(r["count"] for r in shards) < 1300
    assert got.where("doc_id is null").count() == (ALIKE if doc_id is None else 0)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_mixing_deals_rows_alike(spark, doc_id):
    docs = alike(spark, doc_id).unionByName(spark.createDataFrame([(1, "other words", "t"), (2, None, "s")], "doc_id long, text string, source string"))
    mix = mix_sources(docs)
    assert mix.rows.groupBy("sid", "bucket").count().agg(F.max("count")).first()[0] < 2500
    got = taken_words(mix).collect()
    assert len(got) == ALIKE + 2
    taken, target = sum(r.taken for r in got if r.size == 25), next(r.target for r in got if r.size == 25)
    assert taken == round(target) and all(r.taken <= 2 * r.size for r in got)


@pytest.fixture
def plain(spark):
    """No broadcast and no runtime merging of small partitions."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(held, ("-1", "false")):
        spark.conf.set(k, v)
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def test_token_files_deal_rows_alike(spark, plain):
    segments = write_tokens(alike(spark, None), public_tokenizers.path("word_bpe_49k.json"))
    parts = segments.groupBy("part").agg(F.sum(F.size("docs")).alias("n")).collect()
    assert sum(r.n for r in parts) == ALIKE and max(r.n for r in parts) < 0.6 * ALIKE
    some = spark.createDataFrame([(3, "b"), (None, "x y"), (1, None), (None, "")], "doc_id long, text string").withColumn("nth", F.lit("clash"))
    got = read_tokens(write_tokens(some, public_tokenizers.path("word_bpe_49k.json"))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 3] and [r.n_tokens for r in got][2] == 1


def test_rows_without_ids_are_spread(spark, plain):
    found = spark.createDataFrame([(7, "x")], "doc_id long, y string")
    joined = left_lookup(alike(spark, None).unionByName(alike(spark, 7).limit(3)), found)
    most = joined.where("doc_id is null").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 0.4 * ALIKE and joined.where("y = 'x'").count() == 3


def test_sums_before_in_steps(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randrange(9)) for k in range(2) for i in range(300)]
    got = {(r.k, r.i): r.base for r in sums_before(spark.createDataFrame(rows, "k int, i long, v long"), "k", "i", "v", step=16).collect()}
    assert got == {(k, i): sum(v for q, j, v in rows if q == k and j < i) for k, i, _ in rows}


def test_large_and_negative_ids(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(30):
        edited = list(words) if i % 3 else [f"v{rng.randrange(900)}" for _ in range(120)]
        edited[rng.randrange(120)] = "x"
        rows.append(((1 << 62) + i if i % 2 else -(1 << 62) - i, " ".join(edited)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bits", F.lit("clash")).withColumn("node", F.lit(1))
    check(simhash_groups(docs).collect(), rows)


def test_components_of_large_numbers(spark):
    big = (1 << 63) - 1
    edges = [(big - i, big - i - 1) for i in range(40)] + [(-big, -big + 5), (3, 3), (None, 4)]
    got = {r.node: r.low for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {big - i: big - 40 for i in range(41)} | {-big: -big, -big + 5: -big}


def test_rows_without_an_id_in_counts_and_searches(spark):
    docs = spark.createDataFrame([(None, "some words"), (None, None), (1, "some words")], "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = sorted((r.doc_id or 0, r.n_words) for r in token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).collect())
    assert got == [(0, 0), (0, 2), (1, 2)]
    vectors = spark.createDataFrame([(None, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>").withColumn("h", F.lit("clash"))
    assert [(r.query_id, r.vec_id) for r in nearest(vectors, "vec_id % 50 = 0").collect()] == [(50, 3)]
