"""File names of a download run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import text as X
from ..session import durable
from .numbering import number_rows, running

EXTENSION = r"(?s)^.+?(\.[^.]+)$"
NUMBERED = r"(?s)^(.+)\(([1-9][0-9]{0,17})\)$"


def _ext(name: Column) -> Column:
    return F.regexp_extract(name, EXTENSION, 1)


def _stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(_ext(name)))


def history_name(name: Column, link_no: Column) -> Column:
    """``<stem>(과거<j>)<ext>`` for the j-th historical link of a dataset."""
    clean = X.clean_filename(name)
    return X.let(clean, lambda n: F.concat(_stem(n), F.lit(f"({V.HISTORY_MARK}"), link_no.cast("string"), F.lit(")"), _ext(n)))


def manifest(links: DataFrame) -> DataFrame:
    """Directory and wanted name of each file, before collisions are resolved."""
    title = X.clean_filename(F.col("dataset_title"))
    past = F.col("is_history")
    return links.select(
        "*",
        F.when(past, F.concat_ws("/", title, F.lit(V.HISTORY_DIR))).otherwise(title).alias("dir"),
        F.when(past, history_name(F.col("suggested_name"), F.col("link_no")))
        .otherwise(X.clean_filename(F.col("suggested_name")))
        .alias("name"),
    )


def unique_names(files: DataFrame, order: str = "ord") -> DataFrame:
    """Final name per file: the name, then ``stem(1).ext``, ``stem(2).ext`` ....

    ``files`` has (dir, name, ord) with unique ``ord``. A file's place among its equals is a
    running number, so the common case is one numbering pass. A name that itself looks like
    ``stem(n).ext`` may already hold a number when its turn comes; those literal names are
    settled by repeating two keyed joins until nothing changes. Each repeat fixes at least the
    next undecided literal of every stem, so it ends, and it touches only such literals.
    """
    ranked = durable(number_rows(files, [order], "_n", within=("dir", "name")).withColumn("_k", F.col("_n") - 1))
    first = ranked.where("_k = 0").select("dir", "name", F.col(order).alias("taken_at"))
    parsed = first.select(
        "*",
        F.regexp_extract(_stem(F.col("name")), NUMBERED, 1).alias("_base"),
        F.regexp_extract(_stem(F.col("name")), NUMBERED, 2).try_cast("long").alias("num"),
    ).where("_base <> ''")
    repeated = ranked.where("_k = 1").select("dir", F.col("name").alias("base"))
    literal = parsed.select("dir", "name", F.concat("_base", _ext(F.col("name"))).alias("base"), "num", "taken_at")
    # A stem matters when it is repeated, or is itself pushed off its name by another literal.
    bases = repeated.union(literal.select("dir", "name")).distinct()
    state = durable(
        literal.join(bases, ["dir", "base"], "left_semi").select("*", F.lit(False).alias("skip"), F.lit(False).alias("pushed"))
    )
    if state.isEmpty():
        return _named(ranked.withColumn("_used", F.col("_k")), files, order)
    while True:
        new = durable(_settle(ranked, state, order))
        changed = new.join(state.select("dir", "name", F.col("skip").alias("_s"), F.col("pushed").alias("_p")), ["dir", "name"])
        if changed.where("skip <> _s or pushed <> _p").isEmpty():
            break
        state = new
    return _named(_with_used(ranked, new, order), files, order)


def _shifted(ranked: DataFrame, state: DataFrame) -> DataFrame:
    """Turn of each file: 0 keeps its own name; files of a pushed name start at 1."""
    pushed = state.where("pushed").select("dir", "name", F.lit(1).alias("_push"))
    return ranked.join(pushed, ["dir", "name"], "left").withColumn("_turn", F.col("_k") + F.coalesce("_push", F.lit(0)))


def _places(state: DataFrame) -> DataFrame:
    """The turn that would ask for each literal's number, given the literals skipped before it."""
    skips = running(state, ["dir", "base"], ["num"], sums={"_skipped": F.col("skip").cast("long")})
    return skips.withColumn("_at", F.col("num") - (F.col("_skipped") - F.col("skip").cast("long")))


def _settle(ranked: DataFrame, state: DataFrame, order: str) -> DataFrame:
    askers = _shifted(ranked, state).where("_turn >= 1").select(
        "dir", F.col("name").alias("base"), F.col("_turn").alias("_at"), F.col(order).alias("asked_at")
    )
    met = _places(state).join(askers, ["dir", "base", "_at"], "left")
    return met.select(
        "dir", "name", "base", "num", "taken_at",
        F.coalesce(F.col("taken_at") < F.col("asked_at"), F.lit(False)).alias("skip"),
        F.coalesce(F.col("taken_at") > F.col("asked_at"), F.lit(False)).alias("pushed"),
    )


def _with_used(ranked: DataFrame, state: DataFrame, order: str) -> DataFrame:
    """Number each file gets: its turn plus the literals skipped at or before that turn."""
    files = _shifted(ranked, state)
    marks = _places(state).where("skip").select("dir", F.col("base").alias("name"), F.col("_at").alias("_turn"), F.lit(1).alias("_mark"), F.col("num").alias("_tie"))
    both = files.select("*", F.lit(0).alias("_mark"), F.lit(None).cast("long").alias("_tie")).unionByName(marks, allowMissingColumns=True)
    ordered = both.withColumn("_late", 1 - F.col("_mark"))
    counted = running(ordered, ["dir", "name"], ["_turn", "_late", "_tie"], sums={"_over": F.col("_mark").cast("long")})
    return counted.where("_mark = 0").withColumn("_used", F.when(F.col("_turn") > 0, F.col("_turn") + F.col("_over")).otherwise(0))


def _named(rows: DataFrame, files: DataFrame, order: str) -> DataFrame:
    name = F.col("name")
    numbered = F.concat(_stem(name), F.lit("("), F.col("_used").cast("string"), F.lit(")"), _ext(name))
    return rows.select(*files.columns, F.when(F.col("_used") > 0, numbered).otherwise(name).alias("final_name"))
