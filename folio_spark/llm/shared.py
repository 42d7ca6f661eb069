"""Helpers of this subpackage: durable tables, anti-joins, connected components."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.prefilter import maybe_in, sift  # noqa: F401
from ..session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_names(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For stages that call their inner columns ``_name``: the user's columns of such names are
    called otherwise inside the stage, and as before in its result."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        free = (n for n in (f"user_column_{i}" for i in range(2 * len(taken) + 1)) if n not in taken)
        aside = {c: next(free) for c in docs.columns if c.startswith("_")}
        return stage(docs.withColumnsRenamed(aside), *args, **kwargs).withColumnsRenamed({a: c for c, a in aside.items()})

    return run


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and continue from the files.

    A lost executor then costs a re-read; later plans prune columns and know the table's size.
    """
    path = f"{shared_dir(df.sparkSession)}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, name: str, removed: DataFrame, key_name: str) -> DataFrame:
    """Anti-join that shuffles only rows which may match; the others stay where they are."""
    marked = maybe_in(df, name, removed, key_name)
    clear = marked.where(~F.col("_maybe")).drop("_maybe")
    rest = marked.where("_maybe").drop("_maybe")
    gone = removed.select(F.col(key_name).alias("_gone"))
    return clear.unionByName(rest.join(gone, rest[name] == gone["_gone"], "left_anti"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of ``edges``; root is the smallest node of its component.

    Alternates large-star and small-star steps until the edge set stands still. Minima are
    map-side combined, so a hub with very many edges is reduced before the shuffle.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = cut(e, "edges")
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        moved = large.join(low, F.col("u") == F.col("c")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = low.select(F.col("c").alias("u"), F.col("m").alias("v")).union(moved).distinct()
        seen = Observation()  # counted while the table is written
        e = cut(e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")), "edges")
        if (now := seen.get) == mark:
            break
        mark = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
