"""Retry selection, upserts and fail-log reconciliation between runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from .. import vocab as V
from ..functions import text as X
from ..functions import urls as U
from ..functions.detail_html import SKIP_NORMS
from ..session import durable
from ..sources.tables import align
from .numbering import number_rows


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key, null keys counting as one key; reduced map-side."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(last).select(*keys, "_row.*").select(*df.columns)


def whole_number(c: Column) -> Column:
    """The value as a long when it is a whole number, else null."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("long"))


def retry_items(fail_log: DataFrame) -> DataFrame:
    """Items to collect again: detail addresses of the log, last line per address (C17)."""
    trimmed = fail_log.withColumn("url", F.trim("url")).where(
        F.col("url").startswith("http") & U.is_detail_url(F.col("url"))
    )
    kept = number_rows(keep_last(trimmed, ["url"], ["line_no"]), ["line_no"], "_n")
    name, views, downloads = (X.clean_text(F.col(c)) for c in ("dataset_name", "views", "downloads"))
    return kept.select(
        F.coalesce(whole_number(F.col("seq")), F.col("_n")).alias("seq"),
        name.alias("raw_title"),
        name.alias("title"),
        F.lit("").alias("title_source"),
        F.lit("").alias("formats"),
        views.alias("views"),
        downloads.alias("downloads"),
        X.clean_text(F.col("url")).alias("detail_url"),
        F.lit("").alias("source_list_url"),
        *[F.lit(None).cast("string").alias(c) for c in V.CARD_TARGETS],
        X.clean_text(F.col("error")).alias("first_error"),
    )


def retry_target_count(fail_log: DataFrame) -> DataFrame:
    """Distinct addresses worth a retry, without the detail-page test."""
    url = F.trim("url")
    return fail_log.agg(F.countDistinct(F.when(url.startswith("http"), url)).alias("targets"))


def has_retry_targets(fail_log: DataFrame) -> bool:
    return not fail_log.where(F.trim("url").startswith("http")).isEmpty()


def retry_wait(fail_log: DataFrame, now: datetime | Column) -> DataFrame:
    """Seconds left before failed items may be fetched again."""
    at = F.lit(now) if isinstance(now, datetime) else now
    last = fail_log.agg(F.max(F.try_to_timestamp("collected_at")).alias("last"))
    elapsed = F.unix_micros(at.cast("timestamp")) - F.unix_micros("last")
    wait = F.greatest(F.lit(0.0), V.RETRY_WAIT_SECONDS - elapsed / 1_000_000)
    return last.select(F.coalesce(wait, F.lit(0.0)).alias("remain_seconds"))


def _stacked(base: DataFrame, newer: DataFrame) -> DataFrame:
    first = base.withColumn("_src", F.lit(0))
    return first.unionByName(newer.withColumn("_src", F.lit(1)), allowMissingColumns=True)


def upsert_metadata(base: DataFrame, newer: DataFrame, line: str = "line_no") -> DataFrame:
    """Previous rows with the re-collected ones put over them, last per address (C20).

    Unsorted and with its arrival columns, so a sink can sort once (:func:`upserted`).
    """
    return keep_last(_stacked(base, newer), ["detail_url"], ["_src", line])


def upserted(base: DataFrame, newer: DataFrame, line: str = "line_no") -> DataFrame:
    rows = upsert_metadata(base, newer, line)
    return align(rows.orderBy(F.col("seq").asc_nulls_last(), "_src", line), S.METADATA)


def reconcile_fails(old: DataFrame, succeeded: DataFrame, failed_again: DataFrame, line: str = "line_no") -> DataFrame:
    """Old failures that were not retried, plus those that failed again."""
    done = succeeded.select(F.col("detail_url").alias("url")).union(failed_again.select("url")).where("url is not null")
    rest = old.join(done, "url", "left_anti").select(*old.columns)
    return keep_last(_stacked(rest, failed_again), ["url"], ["_src", line]).drop("_src")


def normalize_columns(df: DataFrame, line: str = "line_no") -> DataFrame:
    """Clean a stored column table and renumber it where its numbers are unusable.

    ``line`` is the stored order of the rows. One unusable number anywhere renumbers all.
    """
    def filled(new: str, legacy: str) -> Column:
        if new not in df.columns:
            return F.col(legacy) if legacy in df.columns else F.lit("")
        if legacy not in df.columns:
            return F.col(new)
        return F.when(F.trim(new) == "", F.col(legacy)).otherwise(F.col(new))

    moved = df.withColumns({"descr": filled("descr", "legacy_descr"), "length": filled("length", "legacy_length")})
    rows = moved.select(line, *[c.cast("string").alias(n) for n, c in (
        (n, F.col(n) if n in moved.columns else F.lit("")) for n, _ in V.COLUMN_FIELDS
    )])
    blank = {c: X.is_blank(F.col(c)) for c in ("dataset_name", "name", "descr", "dtype", "length")}
    valued = ~(blank["descr"] & blank["dtype"] & blank["length"])
    is_real = ~blank["name"] & valued & ~X.is_in(X.norm_key(F.col("name")), SKIP_NORMS)
    is_empty = ~blank["dataset_name"] & blank["name"] & ~valued
    # Read three times below: once for the flag, once to number, once for the empty rows.
    kept = durable(rows.select("*", is_real.alias("_real"), is_empty.alias("_empty")).where("_real or _empty").drop("_empty"))

    number = F.col("seq_in_page").try_cast("double")
    unusable = kept.where("_real").agg(F.coalesce(F.max(number.isNull()), F.lit(False))).scalar()
    real = number_rows(kept.where("_real").withColumn("_bad", unusable), [line], "_n", within=("detail_url",))
    seq = F.when(F.col("_bad"), F.col("_n")).otherwise(number.cast("long"))
    emptied = {c: F.lit("") for c, _ in V.COLUMN_FIELDS if c != "dataset_name"}
    names = [c for c, _ in V.COLUMN_FIELDS]
    return real.withColumn("seq_in_page", seq.cast("string")).select(line, *names).unionByName(
        kept.where(~F.col("_real")).withColumns(emptied).select(line, *names)
    )


def run_summary(metadata: DataFrame, columns: DataFrame, fails: DataFrame, elapsed: Column) -> DataFrame:
    """Counts of one run and its rate."""
    kinds = (
        metadata.select(F.lit("ok").alias("kind"))
        .union(columns.select(F.lit("columns")))
        .union(fails.select(F.lit("fail")))
    )
    counted = kinds.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_rows") for k in ("ok", "columns", "fail")])
    processed = F.col("ok_rows") + F.col("fail_rows")
    return counted.select(
        processed.alias("processed"), "ok_rows", F.col("columns_rows").alias("column_rows"), "fail_rows",
        F.coalesce(F.try_divide(processed.cast("double"), elapsed.cast("double")), F.lit(0.0)).alias("rate"),
    )
