"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; a chunk ends where its top bits are zero. Chunking is
normalised: up to the normal size a boundary needs more zero bits than beyond it, which narrows
the spread of sizes. The hash sees the last 16 bytes only, no more than the smallest chunk, so
boundaries depend on content alone and realign after an edit.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

SMALLEST, NORMAL, LARGEST = 16, 48, 1024  # bytes; SMALLEST is also the reach of the gear hash
STRICT_BITS, LOOSE_BITS = 7, 4
BLOCK = 1 << 22  # bytes whose hash is rolled at once; a longer text is a block of its own
GEAR = np.random.default_rng(20240608).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte: the sum of GEAR[b] << distance over the last SMALLEST bytes, by doubling."""
    h = GEAR[raw]
    reach = 1
    while reach < SMALLEST and reach < len(h):
        h[reach:] += h[:-reach] << np.uint32(reach)  # the right side is evaluated before it is added
        reach *= 2
    return h


def _ends(first: int, last: int, marks: list[int], strict: list[bool]) -> list[int]:
    """Chunk ends inside bytes [first, last); ``marks`` are the boundary candidates there."""
    ends, start = [], first
    for at, hard in zip(marks, strict):
        at += 1
        while at - start > LARGEST:
            start += LARGEST
            ends.append(start)
        size = at - start
        if size >= NORMAL or (hard and size >= SMALLEST):
            ends.append(at)
            start = at
    while last - start > LARGEST:
        start += LARGEST
        ends.append(start)
    if start < last:
        ends.append(last)
    return ends


def chunk_sets(texts: list[bytes]) -> list[dict[int, int]]:
    """For each text its set of chunks: 40-bit digest to length in bytes."""
    out, i = [], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
            size += len(texts[j])
            j += 1
        out += _chunk_block(texts[i:j])
        i = j
    return out


def _chunk_block(texts: list[bytes]) -> list[dict[int, int]]:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    raw = b"".join(texts)
    if not raw:
        return [{} for _ in texts]
    h = gear_hash(np.frombuffer(raw, np.uint8))
    marks = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE_BITS)))
    strict = (h[marks] < np.uint32(1 << (32 - STRICT_BITS))).tolist()
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    within = np.searchsorted(marks, edges).tolist()
    marks, edges = marks.tolist(), edges.tolist()
    out = []
    for k in range(len(texts)):
        a, b = within[k], within[k + 1]
        start, chunks = edges[k], {}
        for end in _ends(start, edges[k + 1], marks[a:b], strict[a:b]):
            chunks[digest(raw[start:end]) >> 24] = end - start
            start = end
        out.append(chunks)
    return out


def written(chunks: dict[int, int]) -> str:
    """13 hex digits per distinct chunk, in order of digest: 10 of the digest, 3 of the length."""
    return "".join([f"{d:010x}{n:03x}" for d, n in sorted(chunks.items())])


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Bytes of shared chunks over the bytes of the smaller set; 1 for two empty sets, 0 for one."""
    if not a or not b:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    shared = sum(n for d, n in a.items() if d in b)
    return shared / min(sum(a.values()), sum(b.values()))


def spliced(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many first code points of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compare(batches):
    held = None  # last row: bucket, doc_id, text, chunks
    for batch in batches:
        buckets, ids, texts, tails = (c.to_pylist() for c in batch.columns)
        rows = list(zip(buckets, ids, [t or "" for t in texts], chunk_sets([(t or "").encode() for t in texts])))
        whole, last = ([] if held is None else [held]) + rows, [False] * (held is not None) + tails
        held = None if last[-1] else whole[-1]
        pairs = [(a, b) for a, b, tail in zip(whole, whole[1:], last) if not tail]  # a bucket's rows end with its tail
        edited = [spliced(a[2], b[2]).encode() for a, b in pairs]
        edited_chunks = chunk_sets(edited)
        columns = [
            (pa.int64(), [a[1] for a, _ in pairs]),
            (pa.int64(), [len(a[2]) for a, _ in pairs]),
            (pa.string(), [hashlib.sha256(e).hexdigest() for e in edited]),
            (pa.string(), [written(a[3]) for a, _ in pairs]),
            (pa.string(), [written(e) for e in edited_chunks]),
            (pa.float64(), [containment(a[3], e) for (a, _), e in zip(pairs, edited_chunks)]),
            (pa.float64(), [containment(a[3], b[3]) for a, b in pairs]),
        ]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for k, v in columns], names)


def _buckets(ids: DataFrame, n: int) -> list[int]:
    """At most ``n`` - 1 doc_ids that part the table into about equal ranges."""
    found = ids.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    return sorted({int(v) for v in found})


def fingerprints_with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprint of each text and of its edited text, with their likeness, and likeness to the next.

    The next document is that of the next higher doc_id (after the last: the first); rows of one
    doc_id follow in order of text, and a null doc_id comes first. A null text is empty. Likeness
    is the containment of chunk sets weighted by bytes. A single document is its own next.

    Rows are dealt once, by ranges of doc_id; each range also gets the first document of the next
    range, so no task waits for another. ``buckets`` is the number of ranges
    (spark.sql.shuffle.partitions unless given); one first document per range is broadcast-joined.
    """
    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = np.array(_buckets(rows.select("doc_id"), n), np.int64)

    @F.pandas_udf(LongType())
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), "right"))

    # The null ids come first, so they are of the first range.
    rows = rows.withColumn("bucket", bucket(F.coalesce("doc_id", F.lit(-(1 << 63)))))
    least = rows.groupBy("bucket").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("least"))
    # One row per range; the range before it, cyclically, ends with this range's first document.
    ranges = sorted((r.bucket, r.least) for r in least.collect())
    if not ranges:
        ranges = [(0, 0)]
    before = spark.createDataFrame([(b, v, ranges[i - 1][0]) for i, (b, v) in enumerate(ranges)], "of long, least long, before long")
    at_start = F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("least")
    first = rows.join(F.broadcast(before), (F.col("bucket") == F.col("of")) & at_start).groupBy("before").agg(F.min(F.struct("doc_id", "text")).alias("d"))
    tails = first.select(F.col("before").alias("bucket"), F.col("d.doc_id").alias("doc_id"), F.col("d.text").alias("text"), F.lit(True).alias("tail"))
    dealt = rows.select("bucket", "doc_id", "text", F.lit(False).alias("tail")).unionByName(tails)
    dealt = dealt.repartitionById(n, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "tail", "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("bucket", "doc_id", "text", "tail").mapInArrow(_compare, schema)
