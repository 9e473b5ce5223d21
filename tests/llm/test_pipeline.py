from __future__ import annotations

import random

import pytest

import corpus_pipeline as cp
from barloom.llm.classifier import held_out, score_quality, train_quality_model
from barloom.llm.linededup import line_dedup
from barloom.llm.simhash import simhash_groups

from .test_linededup import brute as brute_lines
from .test_mixing import fill
from .test_simhash import fingerprint, groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    shared = "This very line is in many of the documents of the table"
    rows = []
    for i in range(240):
        words = ["".join(rng.choice("abcdeiou") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(60, 150))]
        if i % 5 == 0:
            words = [w + "###" for w in words]
        text = " ".join(words[:30]) + "\n" + (shared + "\n" if i % 3 == 0 else "") + " ".join(words[30:])
        if i % 10 == 7:
            text = rows[-1][1]
        rows.append((i, text, "en", f"s{i % 4}" if i % 4 else None, len(text)))
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0 if "###" in t else 1, 0) for i, t, *_ in rows if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_each_stage_like_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    all_rows = as_rows(docs)

    kept = cp.quality(spark, docs, sf_dir).cache()
    model = train_quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()))
    good = {r.doc_id for r in score_quality(docs, model).collect() if r.predicted}
    assert as_rows(kept) == [r for r in all_rows if r[0] in good]
    wrong = [r[0] for r in all_rows if (r[0] in good) == ("###" in r[1])]
    assert len(wrong) <= 5

    lined = cp.lines(spark, kept, sf_dir).cache()
    want = brute_lines([(r[0], r[1]) for r in as_rows(kept)])
    assert {r[0]: r[1] for r in as_rows(lined)} == {i: t for i, (_, _, t) in want.items()}
    assert lined.columns == cp.COLUMNS and all(r[4] == len(r[1]) for r in as_rows(lined))

    single = cp.near_duplicates(spark, lined, sf_dir).cache()
    low = groups({r[0]: fingerprint(r[1]) for r in as_rows(lined)})
    assert as_rows(single) == [r for r in as_rows(lined) if low[r[0]] == r[0]]
    assert len(as_rows(single)) < len(as_rows(lined))

    mixed = cp.mixing(spark, single, sf_dir).cache()
    size, took = {}, {}
    for r in as_rows(single):
        size[r[3]] = size.get(r[3], 0) + len(r[1].split())
    for r in mixed.collect():
        took[r.source] = took.get(r.source, 0) + len(r.text.split())
    assert took == pytest.approx(fill(size), abs=1)
    texts = {r[0]: r[1].split() for r in as_rows(single)}
    assert all(texts[r.doc_id][: len(r.text.split())] == r.text.split() for r in mixed.collect())

    packed = cp.packing(spark, mixed, sf_dir).collect()
    assert sum(r.length for r in packed) == sum(took.values())


def test_run_applies_the_stages(spark, sf_dir):
    got = cp.run(spark, sf_dir)
    assert got.columns == ["doc_id", "piece", "length", "bin", "capacity", "place"] and got.count() > 100


def test_rows_without_ids_pass(spark, sf_dir):
    rows = [(None, "some words of a text without an id " * 5, None, None, 3), (1, None, None, "a", 0), (2, "", None, None, 0), (1, None, None, "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    for stage in (cp.lines, cp.near_duplicates, cp.mixing, cp.packing):
        out = stage(spark, docs, sf_dir)
        assert out.count() >= 1
    assert line_dedup(docs).count() == 4 and simhash_groups(docs).count() == 4
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in cp.near_duplicates(spark, docs, sf_dir).collect()) == [(False, 1), (True, 0)]
    empty = spark.createDataFrame([], DOCS)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
