"""SimHash near-dedup by multi-index hashing.

Fingerprints are 64-bit majorities of the XXH64 of word 4-grams. The table of distinct
fingerprints is indexed by bit segments. With ``r`` allowed differences and ``m`` segments, let
``r = m * q + a``: two fingerprints within ``r`` differ by at most ``q`` in one of the first
``a + 1`` segments or by at most ``q - 1`` in one of the others. So each fingerprint looks up
every value in a small Hamming ball around each of its segments, and each match is verified on
all 64 bits inside the join.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, cut, own_names, without

BITS = 64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))  # A-Z only
SHINGLE_WORDS = 4
BLOCK = 1 << 15  # shingles whose bits are spread out at once


def fingerprint(text: bytes | None) -> int:
    """Unsigned fingerprint of UTF-8 text; zero for null and for text without words."""
    import xxhash

    words = (text or b"").translate(LOWER).split()  # splits at 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    width = min(SHINGLE_WORDS, len(words))
    n = len(words) - width + 1
    start, end = start[:n].tolist(), end[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, BLOCK):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(start[i : i + BLOCK], end[i : i + BLOCK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        marks = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], ["doc_id", "mark"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark): one row per row of ``docs``; ``mark`` is the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        _fingerprints, "doc_id long, mark long"
    )


def ball(width: int, radius: int) -> list[int]:
    """XOR masks of all values of ``width`` bits within ``radius`` differences."""
    return [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(width), k)]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def segments(parts: int, radius: int) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) of every segment that has to be probed."""
    q, a = divmod(radius, parts)
    out, shift = [], 0
    for i in range(parts):
        width = BITS // parts + (i >= parts - BITS % parts)
        if (near := q if i <= a else q - 1) >= 0:
            out.append((shift, width, near))
        shift += width
    return out


def _segment(mark: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(mark, shift).bitwiseAND(F.lit((1 << width) - 1))


def _key(seg: int, value: Column) -> Column:
    return value.bitwiseOR(F.lit(seg << 40))


def _xor_each(value: Column, masks: list[int]) -> Column:
    held = F.array(*[F.lit(_signed(m)).cast("long") for m in masks])
    return F.transform(held, lambda m: value.bitwiseXOR(m))


def links(marks: DataFrame, radius: int = 4, parts: int = 3, crowd: int = 64) -> DataFrame:
    """(a, b) links of distinct ``mark`` values whose closure joins all pairs within ``radius``.

    A segment value that more than ``crowd`` fingerprints share (a large group of near copies)
    would pair its members quadratically. Its members and visitors are linked instead through
    the centres they share: two fingerprints are within ``2 * (radius // 2)`` of each other
    exactly if the balls of half that radius around them meet. The work is linear in the group,
    and no link is lost; ``crowd`` only picks the way. ``radius`` must be even.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    cuts = segments(parts, radius)
    own = [_key(i, _segment(F.col("mark"), s, w)) for i, (s, w, _) in enumerate(cuts)]
    index = marks.select(F.explode(F.array(*own)).alias("key"), F.col("mark").alias("b"))
    around = [_xor_each(k, ball(w, near)) for k, (_, w, near) in zip(own, cuts)]
    probe = marks.select(F.explode(F.concat(*around)).alias("key"), F.col("mark").alias("a"))
    crowded = cut(index.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowded")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    open_index = index.join(crowded, "key", "left_anti")
    # Exploded sides are far larger than their files; they must not be taken for broadcast tables.
    found = probe.alias("p").join(open_index.alias("i").hint("merge"), (F.col("p.key") == F.col("i.key")) & (F.col("a") > F.col("b")) & near).select("a", "b")
    if crowded.isEmpty():
        return found
    members = cut(probe.join(crowded, "key", "left_semi").select(F.col("a").alias("mark")).distinct(), "crowd")
    centres = members.select(F.explode(_xor_each(F.col("mark"), ball(BITS, radius // 2))).alias("centre"), "mark")
    shared = centres.groupBy("centre").agg(F.min("mark").alias("first"), F.max("mark").alias("last")).where("first < last")
    met = centres.join(shared.hint("merge"), "centre").where("mark != first").select(F.col("mark").alias("a"), F.col("first").alias("b"))
    return found.union(met.distinct())


def groups(docs: DataFrame, radius: int = 4, parts: int = 3, crowd: int = 64) -> DataFrame:
    """(doc_id, mark, component_id) per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over fingerprints at ``radius`` or fewer
    differing bits, itself included. Null, empty and wordless texts have fingerprint zero and are
    linked like any other. A null doc_id takes part in links but is never a component's id unless
    all members have none (then it is null). Repeated rows get equal answers. Use ``parts = 2``
    (longer segments, larger balls) beyond about 10^8 distinct fingerprints.
    """
    marked = cut(fingerprints(docs), "marks")
    first = cut(marked.groupBy("mark").agg(F.min("doc_id").alias("least_id")), "distinct-marks")
    rooted = components(links(first.select("mark"), radius, parts, crowd), "a", "b")
    joined = first.join(rooted, first["mark"] == rooted["node"], "left").select("mark", "least_id", F.coalesce("root", "mark").alias("root"))
    joined = cut(joined, "mark-roots")
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_mark = joined.join(least, "root").select(F.col("mark").alias("_mark"), "component_id")
    return marked.join(of_mark, marked["mark"] == of_mark["_mark"]).select("doc_id", "mark", "component_id")


@own_names
def keep_one(docs: DataFrame, radius: int = 4, parts: int = 3, crowd: int = 64) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id.

    All columns stay. Rows that share a doc_id are one document, of which one row stays. A row
    with a null doc_id cannot be told from its group and stays.
    """
    at = cut(groups(docs, radius, parts, crowd).select("doc_id", "component_id"), "groups")
    known = at.where("doc_id is not null")
    removed = cut(known.groupBy("doc_id").agg(F.min("component_id").alias("c")).where("doc_id != c").select(F.col("doc_id").alias("_id")), "removed")
    kept = without(docs, "doc_id", removed, "_id")
    repeated = cut(known.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")), "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, kept["doc_id"] == repeated["_id"], "left_semi").dropDuplicates(["doc_id"])
    return without(kept, "doc_id", repeated, "_id").unionByName(once)


def op5_simhash(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint (16 hex digits), component_id."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")
