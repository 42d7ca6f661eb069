"""Bitmap pre-filters: cheap supersets of semi-joins whose broadcast side has a fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def bitmap(keys: DataFrame, name: str, bits: int) -> DataFrame:
    """At most 2^bits / 64 rows (word, word_bits): the size is bounded whatever ``keys`` holds."""
    at = keys.select(slot(F.col(name), bits).alias("s"))
    return at.groupBy(F.expr("shiftright(s, 6)").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("_bits"))


def maybe_in(df: DataFrame, name: str, keys: DataFrame, key_name: str, bits: int = 23) -> DataFrame:
    """``df`` with boolean ``_maybe``: false only where ``name`` is surely not in ``keys``.

    The broadcast side is a bitmap of 2^(bits - 6) words (2 MB at 23), so it does not grow with
    the data; on very large key sets it lets more rows through, and the exact join that follows
    every use decides. Null keys are never in.
    """
    at = df.withColumn("_slot", slot(F.col(name), bits))
    words = F.broadcast(bitmap(keys, key_name, bits))
    hit = at.join(words, F.expr("shiftright(_slot, 6)") == words["_word"], "left")
    seen = F.expr("shiftright(_bits, cast(_slot & 63 as int)) & 1") == 1
    return hit.withColumn("_maybe", F.coalesce(seen & F.col(name).isNotNull(), F.lit(False))).drop("_slot", "_word", "_bits")


def sift(df: DataFrame, name: str, keys: DataFrame, key_name: str, bits: int = 23) -> DataFrame:
    """The rows of ``df`` whose key may be in ``keys`` (a superset of the semi-join)."""
    return maybe_in(df, name, keys, key_name, bits).where("_maybe").drop("_maybe")


# Bits of a block of the wide filter, and how many blocks it has at most (64 MB in all).
BLOCK_BITS, MOST_BLOCKS = 1 << 16, 1 << 13


def _spots(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key, and its two bits there."""
    first, second = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    return F.pmod(first, F.lit(blocks)), [F.shiftright(second, n).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for n in (0, 24)]


def sift_many(df: DataFrame, name: str, keys: DataFrame, key_name: str, expected: int) -> DataFrame:
    """:func:`sift` for about ``expected`` keys: twelve bits each, so that one row in forty passes by chance.

    What is broadcast follows the number of keys up to ``MOST_BLOCKS``; beyond them more rows pass by chance, and the
    exact join that follows decides as ever.
    """
    blocks = max(1, min(MOST_BLOCKS, -(-12 * expected // BLOCK_BITS)))
    block, bits = _spots(F.col(key_name), blocks)
    set_bits = keys.where(F.col(key_name).isNotNull()).select(block.alias("_block"), F.explode(F.array(*bits)).alias("_bit")).select(
        "_block", F.shiftright("_bit", 6).alias("_word"), F.expr("shiftleft(1L, _bit & 63)").alias("_set")
    )
    # Every word has a row, so that a block is the list of its words.
    words = BLOCK_BITS >> 6
    every = df.sparkSession.range(blocks * words).select(F.expr(f"id div {words}").alias("_block"), F.expr(f"cast(id % {words} as int)").alias("_word"), F.lit(0).cast("long").alias("_set"))
    held = set_bits.unionByName(every).groupBy("_block", "_word").agg(F.expr("bit_or(_set)").alias("_set"))
    filled = held.groupBy("_block").agg(F.expr("transform(array_sort(collect_list(struct(_word, _set))), w -> w._set)").alias("_words"))

    at, (a, b) = _spots(F.col(name), blocks)
    probed = df.withColumns({"_at": at, "_a": a, "_b": b})

    def is_set(bit: str) -> Column:
        return F.expr(f"shiftright(get(_words, shiftright({bit}, 6)), {bit} & 63) & 1") == 1

    hit = probed.join(F.broadcast(filled), (F.col("_at") == F.col("_block")) & F.col(name).isNotNull())
    return hit.where(is_set("_a") & is_set("_b")).select(*df.columns)
