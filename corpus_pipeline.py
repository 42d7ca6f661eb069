"""Training-corpus pipeline over ``documents``: each stage reads what the one before kept.

    from corpus_pipeline import run
    kept = run(spark, "/data/tables")

Stages work on whole tables; every one is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio_spark.llm import cgk_decontam, crf_language, line_dedup, poisson_mix, simhash
from folio_spark.llm.shared import cut, table
from folio_spark.session import use_local_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a recognised language."""
    use_local_folder(spark)
    return crf_language.keep_identified(docs, crf_language.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated and near-repeated lines out; documents left without text go."""
    use_local_folder(spark)
    return line_dedup.keep_with_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    use_local_folder(spark)
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    use_local_folder(spark)
    return cgk_decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents to the sources' target weights, in shuffled order; adds copy_no and shuffle_key."""
    use_local_folder(spark)
    return poisson_mix.replicate(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

# Language models, similarity links and edit windows have no SQL form; tests/llm holds the stages
# against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_local_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
