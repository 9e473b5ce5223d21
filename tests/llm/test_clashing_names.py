"""Input columns that have the names of columns made inside the operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barloom.llm.classifier import score_quality, train_quality_model
from barloom.llm.curves import nearest
from barloom.llm.dac import read_tokens, write_tokens
from barloom.llm.linededup import line_dedup
from barloom.llm.mixing import mix_sources, taken_words
from barloom.llm.neardup import near_duplicate_groups
from barloom.llm.packing import best_fit_packing
from barloom.llm.rules import quality_rules, train_ngram_model
from barloom.llm.simhash import simhash_groups
from barloom.llm.substring import substring_dedup
from barloom.llm.tokencount import token_counts
from tests.llm.cases import documents

NAMES = ["mark", "v", "size", "sid", "bucket", "nth", "batch", "salt", "h", "version", "node", "key", "kept", "y", "gram", "row", "spot", "before"]


def clashing(df):
    """The table with string columns of these names, none of them a number."""
    return df.withColumns({n: F.lit("not a number") for n in NAMES if n not in df.columns})


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_documents_with_clashing_columns(spark):
    import public_tokenizers

    plain, _ = documents(spark, 40)
    plain = plain.select("doc_id", "text", "lang", "source", "n_chars").where("length(text) < 4000 or text is null").cache()
    labels = spark.createDataFrame([(3 * i + 1, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    more = clashing(plain)
    piece, word = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "word_bpe_49k.json"))
    sized = lambda d: d.withColumn("length", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    operators = [
        lambda d: token_counts(d, piece),
        lambda d: best_fit_packing(sized(d)),
        lambda d: quality_rules(d, train_ngram_model(d, labels)),
        lambda d: taken_words(mix_sources(d)),
        lambda d: score_quality(d, train_quality_model(d, labels)),
        line_dedup,
        substring_dedup,
        simhash_groups,
        lambda d: read_tokens(write_tokens(d, word)),
        near_duplicate_groups,
    ]
    for operator in operators:
        assert rows_of(operator(more)) == rows_of(operator(plain))


@pytest.mark.parametrize("name", ["embedding", "label"])
def test_vectors_with_clashing_columns(spark, name):
    rows = [(i, [float(i % 7), float(i % 5), 1.0, float(i)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert rows_of(nearest(clashing(df), F.col("vec_id") % 20 == 0)) == rows_of(nearest(df, F.col("vec_id") % 20 == 0))
