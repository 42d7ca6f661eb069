"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A text is its words (runs of letters, digits and underscores, lower case). A document leaks an
item of n words if some run of its words, of any length, is within k = floor(MAX_EDITS * n) word
edits of the item; such a run has n - k to n + k words. The CGK embedding walks through a string, emitting the current word at each of 3n steps
and moving on by a random bit that depends on step and word; strings at a small edit distance
fall back into step, so their embeddings agree in many places. Sampling a few places of the
embedding gives a key; windows of n words and items that share a key in any of several tables are
candidates, and every candidate is verified by the item's exact edit distance to the nearest run of
words in or up to k words around the window.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import own_names

MAX_EDITS = 0.2  # of an item's words
MIN_WORDS = 5  # shorter items are phrases that any text may hold; they leak where they are the whole text
WALKS, KEYS_PER_WALK, PLACES = 6, 16, 3  # embeddings, keys sampled from each, places in a key
ITEMS_PER_BLOCK = 20_000  # items sent to every task at once; more are taken in turns
BLOCK_WORDS = 1 << 20
CLASSES = 1024  # classes of words that share their random bits
WINDOWS = 1 << 14  # windows embedded side by side
PAIR_BITS = 20  # slots of the table of word pairs; sharing one only lets more windows through
OTHER = 0  # id of every word that no item has

WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def allowed(n: int, share: float = MAX_EDITS) -> int:
    return int(share * n)


def edits(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two id lists, or ``most`` + 1 if it is larger; OTHER equals nothing."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        diagonal, row[low - 1] = row[low - 1], (i if low == 1 and i <= most else far)
        best = row[low - 1]
        for j in range(low, high + 1):
            above = row[j] if j < i + most else far
            d = min(diagonal + (x == OTHER or x != b[j - 1]), above + 1, row[j - 1] + 1)
            diagonal, row[j] = row[j], min(d, far)
            best = min(best, row[j])
        if best > most:
            return far
    return row[len(b)]


def nearest(item: list[int], words: list[int]) -> int:
    """Edit distance of ``item`` to the run of ``words`` nearest to it, the empty one too.

    Myers' bit vectors: bit i of ``up`` / ``down`` says that the distance rises / falls from i to
    i + 1 words of the item, for runs that end with the current word and start anywhere.
    """
    n = len(item)
    full, last, at = (1 << n) - 1, 1 << (n - 1), defaultdict(int)
    for i, x in enumerate(item):
        at[x] |= 1 << i
    up, down, score, best = full, 0, n, n
    for x in words:
        same = at.get(x, 0)
        across = (((same & up) + up) ^ up) | same
        rises, falls = (down | ~(across | up)) & full, up & across
        score += bool(rises & last) - bool(falls & last)
        best = min(best, score)
        rises, falls, same = (rises << 1) & full, (falls << 1) & full, same | down
        up, down = (falls | ~(same | rises)) & full, rises & same
    return best


def moves(n: int, walk: int) -> np.ndarray:
    """The walk's random bits by step and symbol class; the class after the last, the end, never moves."""
    bits = np.random.default_rng([walk, 20240610]).integers(0, 2, (2 * n, CLASSES + 1), np.uint8)
    bits[:, CLASSES] = 0
    return bits


def places(n: int, walk: int, keys: int = KEYS_PER_WALK, in_key: int = PLACES) -> np.ndarray:
    """Sampled steps (keys, in_key) of the embedding of n words."""
    rng = np.random.default_rng([n, walk, 20240609])
    return np.sort(np.stack([rng.choice(2 * n, min(in_key, 2 * n), replace=False) for _ in range(keys)]), axis=1)


def symbol_rows(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row per window: its words, then -1 up to the longest window's size and once more."""
    wide = int(sizes.max())
    at = starts[:, None] + np.arange(wide)
    rows = np.full((len(starts), wide + 1), -1, np.int32)
    rows[:, :wide] = np.where(np.arange(wide) < sizes[:, None], ids[np.minimum(at, len(ids) - 1)], -1)
    return rows


def embedded(rows: np.ndarray, walk: int) -> np.ndarray:
    """Emitted word at each of the first 2n steps (n the longest window) of every row.

    The walk moves on by half a word a step on average, so these steps see the whole window; the
    last third of the full embedding is padding for most windows and is not sampled.
    """
    count, wide = rows.shape
    bits = moves(wide - 1, walk)
    symbols = rows.ravel()
    classes = np.where(symbols < 0, CLASSES, (symbols * np.int32(40503) >> 3) % CLASSES)
    out = np.empty((2 * (wide - 1), count), np.int32)
    position = np.arange(count) * wide
    for step in range(len(out)):
        out[step] = symbols[position]
        position += bits[step][classes[position]]
    return out


def sampled_keys(emitted: np.ndarray, n: int, walk: int, keys: int = KEYS_PER_WALK, in_key: int = PLACES) -> np.ndarray:
    """(windows, keys) hashes of the embedding at the places sampled for windows of ``n`` words."""
    at = places(n, walk, keys, in_key)
    out = np.full((keys, emitted.shape[1]), walk + 1, np.uint64)
    for j in range(at.shape[1]):
        out = (out ^ emitted[at[:, j]].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + at[:, j, None].astype(np.uint64)
    out ^= out >> np.uint64(31)
    return (out + np.arange(keys, dtype=np.uint64)[:, None]).T


def window_keys(ids: np.ndarray, starts: np.ndarray, n: int, walk: int, keys: int = KEYS_PER_WALK, in_key: int = PLACES) -> np.ndarray:
    rows = symbol_rows(ids, starts, np.full(len(starts), n))
    return sampled_keys(embedded(rows, walk), n, walk, keys, in_key)


def measured_recall(n: int, walks: int, keys: int, in_key: int, vocabulary: int = 5000, pairs: int = 200, share: float = MAX_EDITS) -> float:
    """Share of simulated pairs at the largest allowed distance that meet in a key."""
    rng = np.random.default_rng([n, 5])
    most, a, b = allowed(n, share), [], []
    for _ in range(pairs):
        x = rng.integers(1, vocabulary, n).tolist()
        y, left = list(x), most
        while left:
            i = int(rng.integers(0, len(y)))
            if rng.random() < 0.5 or left < 2:
                y[i] = int(rng.integers(1, vocabulary))
                left -= 1
            else:  # one word in, one out: the window keeps its size
                y.insert(i, int(rng.integers(1, vocabulary)))
                del y[int(rng.integers(0, len(y)))]
                left -= 2
        a += x
        b += y
    starts = np.arange(pairs) * n
    met = np.zeros(pairs, bool)
    for walk in range(walks):
        met |= (window_keys(np.array(a), starts, n, walk, keys, in_key) == window_keys(np.array(b), starts, n, walk, keys, in_key)).any(axis=1)
    return float(met.mean())


def prepared(items: list[tuple[int, str]], share: float = MAX_EDITS, runs: bool = False) -> dict:
    """What tasks need of some items: word ids, items by length, and the keys of their embeddings.

    With ``runs`` a leak is a run of words of any length within the edits, else an item-sized window.
    """
    vocabulary: dict[str, int] = {}
    by_size = defaultdict(list)
    short: dict[tuple[str, ...], set[int]] = defaultdict(set)
    for item_id, text in items:
        if 0 < len(own := words_of(text)) < MIN_WORDS:
            short[tuple(own)].add(item_id)
            continue
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in own]
        if ids:
            by_size[len(ids)].append((item_id, ids))
    tables = {}
    for n, some in by_size.items():
        flat, starts = np.array([x for _, ids in some for x in ids]), np.arange(len(some)) * n
        for walk in range(WALKS):
            keys = window_keys(flat, starts, n, walk)
            order = np.argsort(keys, axis=None, kind="stable")
            tables[n, walk] = (keys.ravel()[order], order // KEYS_PER_WALK)
    sizes = sorted(by_size)
    pairs = np.zeros(1 << PAIR_BITS, np.uint64)
    for i, n in enumerate(sizes):
        for _, ids in by_size[n]:
            pairs[_pair_slots(np.array(ids))] |= np.uint64(1 << i % 64)
    return {"vocabulary": vocabulary, "by_size": dict(by_size), "sizes": sizes, "tables": tables, "share": share, "pairs": pairs, "runs": runs, "short": dict(short)}


def _pair_slots(ids: np.ndarray) -> np.ndarray:
    h = ids[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ids[1:].astype(np.uint64)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def leaks(texts: list[str | None], held: dict) -> list[set[int]]:
    """Ids of the items that each text leaks.

    Windows are item-sized and start at every word and in the gap before it, so that words missing
    at a text's head count as those missing at its end do. A run within ``k`` edits keeps at least
    ``n - 1 - 2k`` of an item's pairs of neighbouring words, and so does a window of ``n`` words over
    it: a window with fewer pairs that occur in items of its size is not embedded. Items under
    MIN_WORDS words are found by a look-up of the whole text's words.
    """
    found: list[set[int]] = []
    vocabulary, sizes = held["vocabulary"], held["sizes"]
    gap = [OTHER] * (allowed(sizes[-1], held["share"]) + 1) if sizes else []
    ids, start_of, whole = [], [], []
    for i, text in enumerate(texts):
        words = words_of(text)
        whole.append(held["short"].get(tuple(words), ()) if len(words) < MIN_WORDS else ())
        if not sizes:
            found.append(set())
            continue
        start_of.append(len(ids))  # a text starts with the gap before it
        ids += gap
        ids += [vocabulary.get(w, OTHER) for w in words]
        if len(ids) > BLOCK_WORDS or i == len(texts) - 1:
            found += _block_leaks(np.array(ids + gap, np.int64), [*start_of, len(ids)], held, sizes)
            ids, start_of = [], []
    return [hits.union(of_whole) for hits, of_whole in zip(found, whole)]


def _dense_windows(hits: np.ndarray, n: int, need: int, count: int) -> np.ndarray:
    """Starts (below ``count``) of the windows of ``n`` words that hold at least ``need`` of the sorted pair places ``hits``."""
    if count <= 0 or need <= 0:
        return np.arange(max(0, count))
    if len(hits) < need:
        return np.zeros(0, np.int64)
    low, high = np.maximum(hits[need - 1 :] - (n - 2), 0), np.minimum(hits[: len(hits) - need + 1], count - 1)
    low, high = low[low <= high], high[low <= high]
    size = high - low + 1
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.unique(np.repeat(low, size) + inside)


def _block_leaks(ids: np.ndarray, start_of: list[int], held: dict, sizes: list[int]) -> list[set[int]]:
    """``start_of`` ends with the end of the last text, where its gap starts."""
    found: list[set[int]] = [set() for _ in start_of[1:]]
    masks = held["pairs"][_pair_slots(ids)]
    masks[(ids[:-1] == OTHER) | (ids[1:] == OTHER)] = 0
    places_ = np.flatnonzero(masks)
    masks = masks[places_]
    plain = ids.tolist()
    starts, window_sizes = [], []
    for i, n in enumerate(sizes):
        hits = places_[(masks >> np.uint64(i % 64)) & np.uint64(1) == 1]
        starts.append(_dense_windows(hits, n, n - 1 - 2 * allowed(n, held["share"]), min(len(ids) - n + 1, start_of[-1])))
        window_sizes.append(np.full(len(starts[-1]), n))
    starts, window_sizes = np.concatenate(starts), np.concatenate(window_sizes)
    pairs = set()
    for low in range(0, len(starts), WINDOWS):
        some, of = starts[low : low + WINDOWS], window_sizes[low : low + WINDOWS]  # sorted by size
        rows = symbol_rows(ids, some, of)
        for walk in range(WALKS):
            emitted = embedded(rows, walk)
            for n in np.unique(of).tolist():
                own = slice(*np.searchsorted(of, [n, n + 1]))
                keys, owners = held["tables"][n, walk]
                mine = sampled_keys(emitted[:, own], n, walk)
                left, right = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                for i, k in zip(*np.nonzero(right > left)):
                    pairs.update((n, int(some[own][i]), int(o)) for o in owners[left[i, k] : right[i, k]])
    _verify(pairs, plain, start_of, held, found)
    return found


def _verify(pairs: set[tuple[int, int, int]], plain: list[int], start_of: list[int], held: dict, found: list[set[int]]) -> None:
    """Exact edit distance of every candidate (size, start, item), exact copies first."""
    by_size = held["by_size"]
    windows = sorted(pairs, key=lambda p: plain[p[1] : p[1] + p[0]] != by_size[p[0]][p[2]][1])
    texts = (np.searchsorted(start_of, [w for _, w, _ in windows], "right") - 1).tolist()
    for (n, start, o), text in zip(windows, texts):
        item_id, item = by_size[n][o]
        if item_id in found[text]:
            continue
        most = allowed(n, held["share"])
        if held["runs"]:
            around = plain[max(start - most, start_of[text]) : min(start + n + most, start_of[text + 1])]
            distance = nearest
        else:
            around = plain[start : start + n]
            distance = partial(edits, most=most)
        # Words of the item that are not around each cost an edit.
        if sum((Counter(item) - Counter(around)).values()) <= most and distance(item, around) <= most:
            found[text].add(item_id)


def _mark(shared, text_at: int, items_at: int):
    def run(batches):
        for batch in batches:
            hits = leaks(batch.column(text_at).to_pylist(), shared.value)
            both = [sorted({*(old or ()), *new}) for old, new in zip(batch.column(items_at).to_pylist(), hits)]
            columns = [pa.array(both, pa.list_(pa.int64())) if i == items_at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = MAX_EDITS, block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """``docs`` with ``leaked_items``: the sorted ids of the benchmark items each text leaks; map-only.

    Items are taken in turns of ``block``, so what is sent to the tasks is bounded whatever the size
    of the benchmark, and every item is searched in every text. Items without id,
    null or without a word leak nowhere; a null or empty text leaks nothing. Repeated items give their
    id once. An item of fewer than MIN_WORDS words, which allows no edits, leaks where its words are
    the whole text. A document leaks an item if any run of its words, wherever it starts and ends, is within
    the edits: words may be missing at the document's head or end, or stand in between.
    """
    spark = docs.sparkSession
    out = docs.drop("leaked_items").withColumn("leaked_items", F.expr("cast(array() as array<bigint>)"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    known = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").distinct()
    rows = iter(known.orderBy("item_id", "text").toLocalIterator())
    while some := [(r.item_id, r.text) for r in islice(rows, block)]:
        shared = spark.sparkContext.broadcast(prepared(some, share, runs=True))
        out = out.mapInArrow(_mark(shared, out.columns.index("text"), out.columns.index("leaked_items")), fields)
    return out


@own_names
def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that leak a benchmark item; columns as they were."""
    kept = docs.withColumnRenamed("leaked_items", "_before")
    kept = find_leaks(kept, benchmark).where(F.size("leaked_items") == 0).drop("leaked_items")
    return kept.withColumnRenamed("_before", "leaked_items")


def op6_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, leaked_items for every document."""
    out = find_leaks(docs.select("doc_id", "text"), benchmark)
    return out.select("doc_id", (F.size("leaked_items") > 0).alias("contaminated"), "leaked_items")
