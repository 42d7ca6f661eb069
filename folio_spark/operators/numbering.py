"""Global numbering and running values without a single-task window.

Rows are range-partitioned and sorted once, cut durably (range bounds come from a
sample and must not move between two reads), and finished with per-slice totals: a
table of at most one row per (slice, group), whatever one group's size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

_SLICE, _POS, _ID = "_slice", "_pos", "_row"
_SHIFT = 33  # monotonically_increasing_id keeps the partition number above this bit


def sorted_slices(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Range-sort ``df``; adds the slice number and the 1-based position inside it."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = durable(ranged.withColumn(_ID, F.monotonically_increasing_id()))
    return kept.select(
        *df.columns,
        F.shiftright(_ID, _SHIFT).cast("int").alias(_SLICE),
        (F.col(_ID).bitwiseAND(F.lit((1 << _SHIFT) - 1)) + 1).alias(_POS),
    )


def number_rows(
    df: DataFrame, order: Sequence[str], out: str = "seq", within: Sequence[str] = ()
) -> DataFrame:
    """1..n in ``order`` (unique), restarting for each ``within`` group."""
    rows = sorted_slices(df, [F.col(c).asc_nulls_first() for c in (*within, *order)])
    # One row per range partition, so this unpartitioned window and the broadcast stay tiny.
    before = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(_SLICE).agg(F.count("*").alias("_n")).select(
        _SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    numbered = rows.join(F.broadcast(offsets), _SLICE).withColumn(out, F.col("_off") + F.col(_POS))
    if not within:
        return numbered.select(*df.columns, out)
    # Groups are contiguous in the order, so a group's numbers start after its smallest one.
    starts = numbered.groupBy(*within).agg(F.min(out).alias("_first"))
    n, s = numbered.alias("n"), starts.alias("s")
    same = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in within])
    return n.join(s, same).select(
        *[F.col(f"n.{c}") for c in df.columns], (F.col(f"n.{out}") - F.col("s._first") + 1).alias(out)
    )


def running(
    df: DataFrame,
    within: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
) -> DataFrame:
    """Running sums, maxima and last-known values per group, in ``order``.

    A group larger than a slice is continued from the slices before it.
    """
    sums, maxes, lasts = sums or {}, maxes or {}, lasts or {}
    values = {**sums, **maxes, **lasts}
    work = df.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    rows = sorted_slices(work, [F.col(c).asc_nulls_first() for c in (*within, *order)])

    totals = rows.groupBy(_SLICE, *within).agg(
        *[F.sum(f"_v_{n}").alias(n) for n in sums],
        *[F.max(f"_v_{n}").alias(n) for n in maxes],
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(_POS))).alias(n) for n in lasts],
    )
    before = Window.partitionBy(*within).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        _SLICE,
        *within,
        *[F.sum(n).over(before).alias(f"_c_{n}") for n in sums],
        *[F.max(n).over(before).alias(f"_c_{n}") for n in maxes],
        *[F.last(n, ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
    )
    here = Window.partitionBy(_SLICE, *within).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(
        "*",
        *[F.sum(f"_v_{n}").over(here).alias(f"_l_{n}") for n in sums],
        *[F.max(f"_v_{n}").over(here).alias(f"_l_{n}") for n in maxes],
        *[F.last(f"_v_{n}", ignorenulls=True).over(here).alias(f"_l_{n}") for n in lasts],
    ).alias("l")
    c = carried.alias("c")
    same = reduce(
        lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (_SLICE, *within)]
    )
    zero = F.lit(0)
    return local.join(c, same, "left").select(
        *[F.col(f"l.{x}") for x in df.columns],
        *[(F.coalesce(f"_c_{n}", zero) + F.coalesce(f"_l_{n}", zero)).alias(n) for n in sums],
        *[F.greatest(f"_c_{n}", f"_l_{n}").alias(n) for n in maxes],
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in lasts],
    )
