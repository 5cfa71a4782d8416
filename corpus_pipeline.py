"""The corpus pipeline: language, boilerplate lines, near duplicates, benchmark passages, tokens.

Its stages run one after the other in the same executors, so Arrow batches of the session are bounded to 8 MB (see `small_batches`).
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from docledger.llm import decontaminate, jaccard, language, lines, tokens
from docledger.llm.common import small_batches, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter go."""
    small_batches(spark)
    model = language.train(docs.where(~language.held_out() & F.col("doc_id").isNotNull()))
    return language.identify(docs, model).where(F.col("lang_pred") != language.UNKNOWN).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, rid of the boilerplate lines of their source; n_chars follows the text."""
    kept = lines.without_boilerplate(docs)
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    small_batches(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids of each document, with the hashes of ids and decoded bytes."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # executors that ran the stages before have less memory to spare, so workers keep fewer pieces, merge more of them anew and ask smaller queries
    return tokens.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN, kept_pieces=40_000, keep_text=False,
                         query_rows=120_000, slice_bytes=512 << 10)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]
#: Language mixtures and token merges are beyond SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table; every stage in between is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
