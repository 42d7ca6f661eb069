"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cgk_decontam, chunks, crf_language, lattice_lm, line_dedup, merkle_manifest, poisson_mix, preference_chat, quality_rules, simhash, site_style, spelling_groups, weak_toxicity
from .shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op1_lines(table(spark, sf_dir, "documents"))


@_query
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.op2_main_text(table(spark, sf_dir, "pages"))


@_query
def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_texts(table(spark, sf_dir, "documents"))


@_query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_language.op4_language(table(spark, sf_dir, "documents"))


@_query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op5_simhash(table(spark, sf_dir, "documents"))


@_query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cgk_decontam.op6_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op7_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.fingerprints_with_next(table(spark, sf_dir, "documents"))


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_toxicity.op8_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_chat.op9_preference(table(spark, sf_dir, "conversations"))


ORACLES["op9_preference"] = preference_chat.OP9_SQL


@_query
def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.op10_mix(table(spark, sf_dir, "documents"))


ORACLES["op10_poisson_mix"] = poisson_mix.OP10_SQL


@_query
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op13_quality(table(spark, sf_dir, "documents"))


ORACLES["op13_quality"] = quality_rules.OP13_SQL


@_query
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.op11_manifest(table(spark, sf_dir, "documents"))


ORACLES["op11_manifest"] = merkle_manifest.OP11_SQL


@_query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.op12_spelling(table(spark, sf_dir, "documents"))


ORACLES["op12_spelling"] = spelling_groups.OP12_SQL
