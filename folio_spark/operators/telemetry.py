"""Progress and counters from crawl events and log lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import text as X
from ..session import durable
from .numbering import number_rows, running, sorted_slices

LIST_CAP = 30


def _long(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("long")


def _share(done: Column, total: Column, width: int) -> Column:
    """int(done / total * width) with the ratio held in 0..1."""
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), done.cast("double") / F.nullif(total, F.lit(0).cast("long")).cast("double")))
    return F.floor(F.coalesce(ratio, F.lit(0.0)) * width).cast("long")


def _has_all(line: Column, words: list[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & line.contains(F.lit(w))
    return out


# --- running percent ------------------------------------------------------------------------------
# A step either sets the percent ("set"), raises it to a floor ("floor"), or raises it to a floor
# and holds it under the listing cap ("held"). Any chain of steps after a "set" reduces to: the
# running maximum, cut to the cap at the last "held" step, then the floors that follow it.
def _fold_steps(steps: DataFrame, group: list[str], pos: str) -> DataFrame:
    """Adds percent, is_set (a "set" was seen) and is_held (a "held" was seen since)."""
    upto = Window.partitionBy(*group).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    sets = steps.withColumn("_seg", F.sum((F.col("kind") == "set").cast("int")).over(upto))
    seg = Window.partitionBy(*group, "_seg").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    top = sets.select(
        "*", F.max("val").over(seg).alias("_top"), F.sum((F.col("kind") == "held").cast("int")).over(seg).alias("_held")
    )
    value = F.when(F.col("kind") == "held", F.least(F.lit(LIST_CAP), F.col("_top"))).otherwise(F.col("val"))
    run = Window.partitionBy(*group, "_seg", "_held").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("_value", value).select(
        *steps.columns,
        F.max("_value").over(run).alias("percent"),
        (F.col("_seg") > 0).alias("is_set"),
        (F.col("_held") > 0).alias("is_held"),
    )


def running_percent(steps: DataFrame, within: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Percent after each step (columns kind, val), carried across slices of a long log."""
    keys = [*within]
    rows = sorted_slices(steps, [*within, *order])
    local = _fold_steps(rows, ["_slice", *keys], "_pos")
    ends = local.groupBy("_slice", *keys).agg(
        F.max_by(F.struct("percent", "is_set", "is_held"), "_pos").alias("e")
    )
    # A slice without a "set" acts on what comes before it as at most two steps.
    effect = F.when(F.col("e.is_set"), F.array(F.struct(F.lit("set").alias("kind"), F.col("e.percent").alias("val")))).otherwise(
        F.filter(
            F.array(
                F.struct(F.when(F.col("e.is_held"), "held").alias("kind"), F.lit(0).cast("long").alias("val")),
                F.struct(F.lit("floor").alias("kind"), F.col("e.percent").alias("val")),
            ),
            lambda s: s["kind"].isNotNull(),
        )
    )
    summary = ends.select("_slice", *keys, F.posexplode(effect).alias("_k", "s")).select(
        "_slice", *keys, (F.col("_slice") * 2 + F.col("_k")).alias("_ord"), "s.kind", "s.val"
    )
    closed = _fold_steps(summary, keys, "_ord").groupBy("_slice", *keys).agg(F.max_by("percent", "_ord").alias("end"))
    before = Window.partitionBy(*keys).orderBy("_slice")
    carried = closed.select("_slice", *keys, F.coalesce(F.lag("end").over(before), F.lit(0)).alias("_carry"))
    start = F.when(F.col("is_held"), F.least(F.lit(LIST_CAP), F.col("_carry"))).otherwise(F.col("_carry"))
    percent = F.when(F.col("is_set"), F.col("percent")).otherwise(F.greatest("percent", start))
    joined = local.join(carried, ["_slice", *keys])
    return joined.select(*steps.columns, percent.cast("long").alias("percent"))


def log_steps(line: Column, total_pages: Column | int = 0) -> Column:
    """struct(event, kind, val, done, total, ok, fail) for a crawl log line, null if it is not progress."""
    est = _long(total_pages)

    def group(pattern: str, i: int) -> Column:
        return X.progress_int(F.regexp_extract(line, X.rx(pattern), i))

    none = F.lit(None).cast("long")

    def step(event: str, kind: Column | str, val: Column | int, done=none, total=none, ok=none, fail=none) -> Column:
        k = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(
            F.lit(event).alias("event"), k.alias("kind"), _long(val).alias("val"), done.alias("done"),
            total.alias("total"), ok.alias("ok"), fail.alias("fail"),
        )

    page = group(V.LOG_LIST_START, 1)
    pages = F.when(est > 0, est).otherwise(group(V.LOG_LIST_START, 2))
    known = pages > 0
    listing = step("list", F.when(known, "set").otherwise("held"), F.when(known, 5 + _share(page, pages, 25)).otherwise(8), page, pages)
    seen = group(V.LOG_LIST_DONE, 1)
    listed = step(
        "list_page", F.when(est > 0, "set").otherwise("held"), F.when(est > 0, 5 + _share(seen, est, 25)).otherwise(10),
        group(V.LOG_LIST_DONE, 3), group(V.LOG_LIST_DONE, 4),
    )
    done, total = group(V.LOG_DETAIL, 1), group(V.LOG_DETAIL, 2)
    detail = step("detail", "set", 30 + _share(done, total, 65), done, total, group(V.LOG_DETAIL, 4), group(V.LOG_DETAIL, 5))
    return (
        F.when(line.rlike(X.rx(V.LOG_LIST_START)), listing)
        .when(line.rlike(X.rx(V.LOG_LIST_DONE)), listed)
        .when(line.rlike(X.rx(V.LOG_URLS_DONE)), step("urls_done", "set", 30, total=group(V.LOG_URLS_DONE, 1)))
        .when(line.rlike(X.rx(V.LOG_DETAIL)), detail)
        .when(X.any_of(V.LOG_RECOVERY, line), step("recovery", "floor", 95))
        .when(X.any_of(V.LOG_FINISH, line), step("finish", "floor", 96))
    )


def message_steps(msg: Column) -> Column:
    """struct(kind, val) for a status message, null if it leaves the percent alone."""
    def step(kind: str, val: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(val).cast("long").alias("val"))

    text = X.clean_text(msg)
    return (
        F.when(text.rlike(X.rx(V.MSG_URLS_DONE)), step("set", 30))
        .when(X.any_of(V.MSG_FILE, text), step("set", 98))
        .when(_has_all(text, V.MSG_URLS), step("floor", 10))
        .when(X.any_of(V.MSG_DETAIL, text), step("floor", 30))
    )


def progress_events(log: DataFrame, total_pages: Column | int = 0) -> DataFrame:
    """Progress events of crawl logs with the percent shown after each."""
    lines = log.select("job_id", "line_no", F.trim("line").alias("line"))
    read = X.where_once(
        lines.select("job_id", "line_no", log_steps(F.col("line"), total_pages).alias("s")), lambda r: r["s"].isNotNull()
    )
    # Sorting reads its input twice (sample, then shuffle); the few progress lines are kept for that.
    steps = durable(read.select("job_id", "line_no", "s.*"))
    return running_percent(steps, ["job_id"], ["line_no"]).drop("kind", "val")


def payload_percent(stage: Column, percent: Column, page: Column, max_pages: Column, done: Column, total: Column) -> Column:
    """Percent of a progress payload (E4); an explicit percent wins."""
    def n(c: Column) -> Column:
        return F.coalesce(c.cast("long"), F.lit(0).cast("long"))

    share = F.floor(n(page).cast("double") / F.nullif(n(max_pages), F.lit(0).cast("long")).cast("double") * 25)
    at_least_one = F.greatest(F.when(n(total) == 0, 1).otherwise(n(total)), F.lit(1))
    detail = 30 + F.floor(n(done).cast("double") / at_least_one.cast("double") * 60)
    by_stage = (
        F.when(stage.isin("list", "list_start"), F.when(n(max_pages) > 0, 5 + F.least(F.lit(25), share)).otherwise(10))
        .when(stage.isin("list_done", "detail_start"), 30)
        .when(stage == "detail", detail)
        .when(stage == "detail_done", 90)
        .when(stage == "save", 95)
        .when(stage == "done", 100)
        .otherwise(5)
    )
    return X.clamp_percent(F.coalesce(percent.cast("long"), by_stage.cast("long")))


def counts_percent(line: Column, expected_pages: Column | int) -> Column:
    """Percent shown for a line of the counts walk."""
    text = X.clean_text(line)
    page = X.first_filled(*[F.regexp_extract(text, X.rx(p), 1) for p in V.COUNTS_PAGE])
    share = F.floor(page.try_cast("double") / _long(expected_pages).cast("double") * 90)
    moved = F.when(page != "", 5 + F.least(F.lit(90), share)).otherwise(5)
    return F.when(text.contains(V.COUNTS_DONE), 100).otherwise(moved).cast("long")


def download_events(log: DataFrame, expected_pages: Column | int = 1) -> DataFrame:
    """Each download log line with its class, counters so far and percent (E5)."""
    read = log.select("job_id", "line_no", X.clean_text(F.col("line")).alias("t"))
    t = F.col("t")
    captured = read.select(
        "*",
        X.first_filled(*[F.regexp_extract(t, X.rx(p), 1) for p in V.DL_PAGE]).alias("page"),
        F.regexp_extract(t, X.rx(V.DL_TARGETS), 1).alias("targets"),
        *[F.regexp_extract(t, X.rx(V.DL_ITEM), i).alias(n) for i, n in ((1, "item"), (2, "of"))],
    )
    kind = (
        F.when(F.col("page") != "", "page")
        .when(F.col("targets") != "", "targets")
        .when(F.col("item") != "", "item")
        .when(t.contains(V.DL_CURRENT_SAVED), "current_saved")
        .when(_has_all(t, V.DL_HISTORY), "past_saved")
        .when(X.any_of(V.DL_FAILED, t), "failed")
        .when(t.contains(V.DL_DONE), "done")
        .otherwise("other")
    )
    whole = F.when(F.col("targets") != "", X.progress_int(F.col("targets"))).otherwise(
        F.greatest(F.col("of").try_cast("long"), F.lit(1))
    )
    # Sorting reads its input twice (sample, then shuffle); the short classified rows are kept for that.
    lines = durable(
        captured.select(
            "job_id", "line_no", kind.alias("kind"), F.col("page").try_cast("long").alias("page"),
            F.col("item").try_cast("long").alias("cur"), whole.alias("whole"),
        )
    )
    is_kind = {k: (F.col("kind") == k).cast("long") for k in ("current_saved", "past_saved", "failed")}
    counted = running(
        lines,
        ["job_id"],
        ["line_no"],
        sums=is_kind,
        lasts={
            "current": F.when(F.col("kind") == "item", F.col("cur")),
            "total": F.when(F.col("kind").isin("targets", "item"), F.col("whole")),
        },
    )
    current, total = (F.coalesce(c, F.lit(0).cast("long")) for c in ("current", "total"))
    moved = 30 + F.floor(current.cast("double") / F.greatest(total, F.lit(1)).cast("double") * 60)
    page = 5 + F.least(F.lit(25), F.floor(F.col("page").cast("double") / _long(expected_pages).cast("double") * 25))
    percent = (
        F.when(F.col("kind") == "page", page)
        .when(F.col("kind") == "targets", 30)
        .when(F.col("kind").isin("item", "current_saved", "past_saved", "failed"), moved)
        .when(F.col("kind") == "done", 98)
        .otherwise(5)
    )
    return counted.select(
        "job_id", "line_no", "kind", "current_saved", "past_saved", "failed",
        current.alias("current"), total.alias("total"), percent.cast("long").alias("percent"),
    )


def outcome_counters(events: DataFrame, order: list[str]) -> DataFrame:
    """Running ok/fail/deferred of each job and the share done."""
    kinds = {k: (F.col("outcome") == k).cast("long") for k in ("ok", "fail", "deferred")}
    counted = running(events, ["job_id"], order, sums={f"n_{k}": v for k, v in kinds.items()})
    done = F.col("n_ok") + F.col("n_fail") + F.col("n_deferred")
    whole = F.greatest(F.coalesce(F.col("total").cast("long"), F.lit(0)), F.lit(1))
    return counted.select(
        "job_id", *order, "n_ok", (F.col("n_fail") + F.col("n_deferred")).alias("n_fail_shown"), "n_deferred",
        done.alias("done"), (done * 100 / whole).cast("double").alias("percent"),
    )


def block_cooldowns(signals: DataFrame, enabled: bool = False) -> DataFrame:
    """Running count of block signals per job and the pause each one asks for.

    Pauses never get shorter and signals are in time order, so the pause in force after a
    signal is that signal's own.
    """
    counted = number_rows(signals, ["ts", "signal_id"], "n_signals", within=("job_id",))
    pause = F.least(
        F.lit(V.BLOCK_COOLDOWN_MAX), V.BLOCK_COOLDOWN_STEP * F.least(F.col("n_signals"), F.lit(V.BLOCK_COOLDOWN_STEPS))
    ).cast("long")
    until = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 + pause if enabled else F.lit(0.0)
    return counted.select("job_id", "ts", "signal_id", "n_signals", pause.alias("cooldown"), until.cast("double").alias("cooldown_until"))
