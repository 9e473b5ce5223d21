"""The queries of the thirteen operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import oracles
from barloom.llm.common import table, word_count


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from barloom.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.packing import best_fit_packing

    docs = table(spark, sf_dir, "documents").select("doc_id", word_count("text").alias("length"))
    return best_fit_packing(docs)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.rules import quality_rules, train_ngram_model

    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, train_ngram_model(docs, table(spark, sf_dir, "labels")))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.mixing import mix_sources, taken_words

    return taken_words(mix_sources(table(spark, sf_dir, "documents")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.classifier import held_out, score_quality, train_quality_model

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scores = score_quality(docs, train_quality_model(docs, labels))
    return scores.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.linededup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.substring import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from barloom.llm.dac import read_tokens, write_tokens

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op10_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.curves import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.codes import code_vectors

    return code_vectors(table(spark, sf_dir, "embeddings"))


def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.chat import chat_windows, read_windows
    from barloom.llm.common import written

    both = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", both), (-1, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_windows(written(chat_windows(turns), "chat"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``documents`` with a periodic end planted in a tenth of them: with h the CRC-32
    of the decimal doc_id and g = h // 10, where h % 10 = 0 each word i >= a is
    word a + (i - a) % p, with a = g % n and p = 1 + (n - a) // (3 + g % 8)."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("g", F.floor(F.col("h") / 10))
    some = some.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    some = some.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    ending = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, element_at(w, CAST(a + (i - a) % p + 1 AS INT)))), ' ')")
    return some.select("doc_id", F.when(F.col("a").isNotNull(), ending).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.runs import periodic_runs

    found = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    exponent = F.expr("best.length * 1000 div best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent.alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_source_mixing": op4_source_mixing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_line_dedup": op6_line_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_simhash": op8_simhash,
    "op9_token_output": op9_token_output,
    "op10_curve_neighbours": op10_curve_neighbours,
    "op11_vector_codes": op11_vector_codes,
    "op12_chat_windows": op12_chat_windows,
    "op13_periodic_runs": op13_periodic_runs,
}
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op6_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        lines AS (
            SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM split),
        keyed AS (
            SELECT *, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') AS key FROM lines),
        common AS (
            SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (
            SELECT k.*, coalesce(k.doc_id <> c.last, false) AS gone FROM keyed k LEFT JOIN common c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op7_substring_dedup": r"""
        WITH docs AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        windows AS (
            SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM docs)),
        again AS (
            SELECT doc_id, i FROM windows JOIN (SELECT h, min(doc_id) AS low FROM windows GROUP BY h) USING (h) WHERE doc_id > low),
        covered AS (SELECT DISTINCT doc_id, i + k AS j FROM again CROSS JOIN range(50) t(k)),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM docs),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, j) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (doc_id)
    """,
}
ORACLES |= oracles.ORACLES
