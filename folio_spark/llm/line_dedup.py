"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard, union-find.

A line is what stands between line feeds. Lines are compared in lower case with white space
collapsed; equal ones are one text, named by the 64-bit XXH3 of its UTF-8. Texts whose signatures
agree in one band share a bucket and are compared exactly: the Jaccard index of their sets of
character shingles.

Inside a bucket a text is compared with all others at once, and texts that are already linked to
the bucket's largest component are not taken up again: what lies outside of it is compared with
everything, which leaves no pair of different components open. Only links leave the task. Buckets
beyond BUCKET texts are dealt to several tasks in chunks; there the texts outside the largest
component are compared, as a query set, with every chunk.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, cut, own_names, sift

SHINGLE = 8  # characters
BANDS, ROWS = 10, 4  # finds a pair at Jaccard 0.8 with probability 0.995, at 0.9 with more than 0.9999
THRESHOLD = 0.8
BLOCK = 1 << 16  # characters whose shingles are hashed at once
BUCKET = 1024  # texts of a bucket that are compared in one task
FEW = 12  # texts of a bucket up to which sets of strings are intersected one by one


def normal_lines(text: str | None) -> list[str]:
    return [" ".join(line.split()) for line in (text or "").lower().split("\n")]


def line_id(line: str) -> int:
    import xxhash

    v = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return v - (1 << 64) if v >> 63 else v


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)


def signatures(lines: list[str], shingle: int, n: int) -> np.ndarray:
    """``n`` minima per line; every line has at least ``shingle`` characters."""
    mul, mask = _multipliers(n)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    windows = len(points) - shingle + 1
    h = points[:windows].astype(np.uint64)
    for j in range(1, shingle):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= points[j : windows + j]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h = (h >> np.uint64(32)).astype(np.uint32)
    # Windows that reach into the next line do not count.
    own = np.ones(windows, bool)
    ends = np.cumsum(size)[:-1]
    for j in range(1, shingle):
        own[ends - j] = False
    h = h[own]
    at = np.concatenate([[0], np.cumsum(size - shingle + 1)[:-1]])
    out, work = np.empty((n, len(lines)), np.uint32), np.empty_like(h)
    for i in range(n):
        np.multiply(h, mul[i], out=work)
        np.bitwise_xor(work, mask[i], out=work)
        out[i] = np.minimum.reduceat(work, at)
    return out


def band_keys(lines: list[str], shingle: int, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key per line and band; the band's number is part of the key."""
    out = np.empty((len(lines), bands), np.int64)
    i = 0
    while i < len(lines):
        j, chars = i, 0
        while j < len(lines) and (j == i or chars + len(lines[j]) <= BLOCK):
            chars += len(lines[j])
            j += 1
        sig = signatures(lines[i:j], shingle, bands * rows).astype(np.uint64)
        for b in range(bands):
            key = np.full(j - i, b + 1, np.uint64)
            for r in range(rows):
                key = (key ^ sig[b * rows + r]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
            out[i:j, b] = key.view(np.int64)
        i = j
    return out


def _line_rows(shingle: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            ids, numbers, names, fresh, fresh_at, seen = [], [], [], [], [], set()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for number, line in enumerate(normal_lines(text)):
                    if not line:
                        continue
                    name = line_id(line)
                    if len(line) >= shingle and name not in seen:
                        seen.add(name)
                        fresh.append(line)
                        fresh_at.append(len(names))
                    ids.append(doc_id)
                    numbers.append(number)
                    names.append(name)
            length = np.zeros(len(names), np.int64)
            length[fresh_at] = bands
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            flat = band_keys(fresh, shingle, bands, rows).ravel()
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(names, pa.int64()), keys], ["doc_id", "line_no", "line", "keys"]
            )

    return run


def _texts(shingle: int):
    def run(batches):
        for batch in batches:
            found = {}
            for text in batch.column(0).to_pylist():
                for line in normal_lines(text):
                    if len(line) >= shingle:
                        found[line_id(line)] = line
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], ["line", "body"])

    return run


def jaccard(a: str, b: str, shingle: int = SHINGLE) -> float:
    """Jaccard index of two lines' shingle sets; a shorter line is its own only shingle."""
    x = {a[i : i + shingle] for i in range(max(1, len(a) - shingle + 1))}
    y = {b[i : i + shingle] for i in range(max(1, len(b) - shingle + 1))}
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _letters_as_bytes(bodies: list[str]) -> list[bytes] | None:
    """The texts with one byte a character; None if they have more than 256 different ones."""
    try:
        return [body.encode("latin-1") for body in bodies]
    except UnicodeEncodeError:
        letters = set().union(*bodies)
        if len(letters) > 256:
            return None
        table = {ord(c): i for i, c in enumerate(letters)}
        return [body.translate(table).encode("latin-1") for body in bodies]


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def bucket_links(names: list[int], bodies: list[str], shingle: int, threshold: float, asked: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links whose closure joins all texts of a bucket within the threshold.

    With ``asked``, only pairs with a text that is asked for are looked at, all of them.
    """
    # Eight characters of a byte each are one exact number, so no shingle is made a string of its own.
    data = _letters_as_bytes(bodies) if shingle == 8 else None
    if data is not None:
        sets = [_distinct(np.ndarray(len(x) - 7, "<u8", x, strides=(1,))) for x in data]
    else:
        sets = [{body[i : i + shingle] for i in range(len(body) - shingle + 1)} for body in bodies]
    size = np.array([len(x) for x in sets])
    counted = data is not None or len(sets) > FEW
    if counted:
        ends = np.cumsum(size)
        if data is not None:
            numbers, flat = np.unique(np.concatenate(sets), return_inverse=True)
            sets = np.split(flat, ends[:-1])
        else:
            numbers = {x: i for i, x in enumerate(set().union(*sets))}
            sets = [np.fromiter([numbers[x] for x in own], np.int32, len(own)) for own in sets]
            flat = np.concatenate(sets)
        at, mark = np.concatenate([[0], ends[:-1]]), np.zeros(len(numbers), np.int32)

    def shared(x: int) -> np.ndarray:
        """Shingles that text x has in common with each."""
        if not counted:
            return np.array([len(sets[x] & other) for other in sets])
        mark[sets[x]] = 1
        both = np.add.reduceat(mark[flat], at)
        mark[sets[x]] = 0
        return both

    root, count = list(range(len(names))), Counter({i: 1 for i in range(len(names))})

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links: list[tuple[int, int]] = []
    largest, open_ = 0, [i for i in range(len(names)) if asked is None or asked[i]]
    while open_:
        later = []
        for x in open_:
            if asked is None and x != largest and find(x) == find(largest):
                later.append(x)  # is taken up if another component outgrows this one
                continue
            both = shared(x)
            for y in np.flatnonzero(both >= threshold * (size[x] + size - both)).tolist():
                a, b = find(x), find(y)
                if a != b:
                    root[b] = a
                    count[a] += count.pop(b)
                    links.append((names[x], names[y]))
            if count[find(x)] > count[find(largest)]:
                largest = x
        open_ = later if any(find(x) != find(largest) for x in later) else []
    return links


def _bucket_rows(shingle: int, threshold: float):
    """Rows come sorted by bucket and chunk; a group is at hand before its links are made."""

    def made(rows):
        rows = list({r[2]: r for r in reversed(rows)}.values())  # a text that is asked for comes first
        asked = [r[4] for r in rows]
        return bucket_links([r[2] for r in rows], [r[3] for r in rows], shingle, threshold, asked if any(asked) else None) if len(rows) > 1 else []

    def run(batches):
        held = []
        for batch in batches:
            rows = held + list(zip(*(c.to_pylist() for c in batch.columns)))
            groups = [list(g) for _, g in groupby(rows, key=lambda r: r[:2])]
            held = groups.pop() if groups else []
            links = [link for g in groups for link in made(g)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], ["a", "b"])
        links = made(held)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], ["a", "b"])

    return run


def _compared(rows: DataFrame, bodies: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Links found in the groups (key, chunk) of ``rows`` (key, chunk, line, asked)."""
    texts = rows.join(bodies, "line").select("key", "chunk", "line", "body", "asked")
    dealt = texts.repartition("key", "chunk").sortWithinPartitions("key", "chunk", F.desc("asked"))
    return dealt.mapInArrow(_bucket_rows(shingle, threshold), "a long, b long")


def _similar(docs: DataFrame, lines: DataFrame, shingle: int, threshold: float, bucket: int) -> DataFrame:
    """(node, root) of the lines that are similar to another, closed by union-find."""
    keyed = lines.select(F.explode("keys").alias("key"), "line")
    # Buckets with more than one text; hot buckets shrink to one row per task before the shuffle.
    live = cut(keyed.groupBy("key").agg(F.min("line").alias("first"), F.max("line").alias("last")).where("first < last").select("key"), "live-bands")
    members = sift(keyed, "key", live, "key").distinct().join(live, "key", "left_semi")
    members = cut(members, "band-members")
    bodies = docs.select("text").mapInArrow(_texts(shingle), "line long, body string")
    bodies = cut(sift(bodies, "line", members, "line").dropDuplicates(["line"]), "bodies")
    # Near copies meet in many bands: buckets of the same texts (by count and two hashes) are
    # looked at once. Large buckets all stay, so that their chunks mix.
    marks = [F.bit_xor(F.xxhash64("line", F.lit(i))).alias(f"h{i}") for i in range(2)]
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), *marks)
    alone = F.when(F.col("n") > bucket, F.col("key")).otherwise(0)
    sizes = sizes.groupBy("n", "h0", "h1", alone.alias("alone")).agg(F.min("key").alias("key"))
    sizes = sizes.select("key", F.ceil(F.col("n") / F.lit(float(bucket))).cast("int").alias("chunks"))
    # A text falls in another chunk in every band, so most chunks meet through other buckets.
    chunk = F.pmod(F.xxhash64("key", "line"), F.col("chunks")).cast("int")
    dealt = cut(members.join(sizes, "key").select("key", "chunks", "line", chunk.alias("chunk")), "dealt-members")
    links = cut(_compared(dealt.select("key", "chunk", "line", F.lit(False).alias("asked")), bodies, shingle, threshold), "links")
    rooted = components(links, "a", "b")
    large = cut(dealt.where("chunks > 1"), "large-buckets")
    if large.isEmpty():
        return rooted
    known = large.join(rooted, large["line"] == rooted["node"], "left").select("key", "chunks", "line", "chunk", F.coalesce("root", "line").alias("root"))
    known = cut(known, "rooted-members")
    most = known.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("most"))
    asked = known.join(most, "key").where("root != most")
    asked = asked.select("key", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), "line", F.lit(True).alias("asked"))
    rest = known.join(asked.select("key").distinct(), "key", "left_semi").select("key", "chunk", "line", F.lit(False).alias("asked"))
    more = cut(_compared(asked.union(rest), bodies, shingle, threshold), "links")
    return components(links.union(more), "a", "b")


def dropped_lines(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, bucket: int = BUCKET) -> DataFrame:
    """(_doc, line_no, line) of the lines to drop: all but the first of each component, by (doc_id, line_no).

    A null doc_id (``_doc`` null) comes after all others. Rows that share a doc_id are one document.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = cut(narrow.mapInArrow(_line_rows(shingle, bands, rows), "doc_id long, line_no int, line long, keys array<long>"), "lines")
    where = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no")
    first = lines.groupBy("line").agg(F.min(where).alias("first"), F.count("*").alias("n"))
    similar = _similar(narrow, lines, shingle, threshold, bucket)
    named = first.join(similar, first["line"] == similar["node"], "left")
    # Only texts that occur twice or have a similar one can lose a line.
    named = cut(named.where("n > 1 or root is not null").select("line", "first", F.coalesce("root", "line").alias("root")), "shared-lines")
    kept = named.groupBy("root").agg(F.min("first").alias("kept"))
    kept = cut(named.join(kept, "root").select("line", "kept"), "kept-lines")
    again = sift(lines.select("doc_id", "line_no", "line"), "line", kept, "line").join(kept, "line")
    return again.where(~where.eqNullSafe(F.col("kept"))).select(F.col("doc_id").alias("_doc"), "line_no", "line").distinct()


def _without_lines(batches):
    for batch in batches:
        names = batch.schema.names
        text, gone = batch.column(names.index("text")).to_pylist(), batch.column(names.index("_gone")).to_pylist()
        total, kept, out = [], [], []
        for t, g in zip(text, gone):
            lines = [] if t is None else t.split("\n")
            drop = {(x["line_no"], x["line"]) for x in g or ()}
            numbers = {n for n, _ in drop}
            plain = normal_lines(t) if drop else []
            left = [x for i, x in enumerate(lines) if i not in numbers or (i, line_id(plain[i])) not in drop]
            total.append(len(lines))
            kept.append(len(left))
            out.append(None if t is None else "\n".join(left))
        columns = [pa.array(out, pa.string()) if n == "text" else batch.column(i) for i, n in enumerate(names)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int32()), pa.array(kept, pa.int32())], [*names, "_lines", "_kept"])


def dedup_lines(
    docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, bucket: int = BUCKET
) -> DataFrame:
    """``docs`` with repeated and near-repeated lines taken out of ``text``; all rows and columns stay.

    Of each component of lines the first by (doc_id, line number) stays, anywhere in the corpus. Two
    texts are linked if the Jaccard index of their character shingle sets is at least ``threshold``;
    texts shorter than ``shingle`` are linked only if equal. Blank lines stay. A null text stays null.
    Adds ``_lines`` and ``_kept`` (how many lines the text had and has). Rows that share a doc_id are
    one document: a line that stays is kept in each row that has it in that place. Lines of null ids
    are last in order, so of a repeated line the copy under a known id stays.
    """
    gone = dropped_lines(docs, shingle, threshold, bands, rows, bucket).groupBy("_doc").agg(F.collect_set(F.struct("line_no", "line")).alias("_gone"))
    joined = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_doc"]), "left").drop("_doc")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema)
    return joined.mapInArrow(_without_lines, f"{fields}, _lines int, _kept int").drop("_gone")


@own_names
def keep_with_lines(docs: DataFrame) -> DataFrame:
    """``docs`` after line dedup, without documents that lost all their text; columns as they were.

    A document stays if a line with more than white space is left or none was dropped; ``n_chars``,
    if there, follows the text.
    """
    out = dedup_lines(docs).where((F.col("_kept") == F.col("_lines")) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_kept") == F.col("_lines"), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text without repeated lines, n_chars of it, n_lines before, n_kept."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.col("_lines").alias("n_lines"), F.col("_kept").alias("n_kept"))
