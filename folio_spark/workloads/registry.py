"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PORTAL = "https://portal.example"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(pages: DataFrame, key: str) -> DataFrame:
    """Pages spread as a stored table would be.

    Built pages compress so well that adaptive execution packs them into one or two
    partitions, which is right for bytes and wrong for the parsing that follows. A real
    page table is split by file size and needs nothing of the kind.
    """
    return pages.repartition(2 * pages.sparkSession.sparkContext.defaultParallelism, key)
