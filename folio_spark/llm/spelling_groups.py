"""Spelling variants by a variable-length gram index.

A word stands between marks and is read in grams of ``SHORT`` to ``LONG`` characters. The
dictionary is pruned by frequency: a gram is extended by one character only where it fills more
than one in ``SHARE`` of all gram places of the vocabulary. A word is decomposed at each place
into the longest gram of the dictionary (the shortest length always counts), without grams that
lie inside an earlier one.

For every edit a word can suffer, the grams are bounded which it may affect: those over the edit,
and those beside it that a longer gram across the edit could swallow (its near part is a proper
prefix, or suffix, of a dictionary gram). What lies outside the bound is found again in the edited
word. So the lists of the nearest unaffected gram to the left and to the right are merged: the
other word stands in both, with all that precedes the one and follows the other. There are enough
marks that an edit leaves a gram on one side at least, and that both sides together keep all but
a few characters, so merged lists are short. What they share is verified by edit distance.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

NOT_LETTERS = "[^A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT = 5, 3
SHORT, LONG = 3, 4  # characters of a gram
SHARE = 5_000  # at most so many grams of a length are extended, each by the letters of the alphabet
FACTOR = 2  # a form is at least so many times as frequent
TYPO = 97  # the query drops a letter of one in so many distinct words of a document
PRIME, BASE = (1 << 61) - 1, 1_000_003  # of the hashes of what precedes and follows a gram
ROWS = 1 << 16  # keys that leave a task at once


class Dictionary(NamedTuple):
    """``grams`` over the shortest length, with their proper prefixes and suffixes of at least it."""

    grams: frozenset[str]
    heads: frozenset[str]
    tails: frozenset[str]
    short: int
    long: int


def dictionary_of(grams, short: int = SHORT, long: int = LONG) -> Dictionary:
    grams = frozenset(grams)
    heads = frozenset(g[:k] for g in grams for k in range(short, len(g)))
    tails = frozenset(g[k:] for g in grams for k in range(1, len(g) - short + 1))
    return Dictionary(grams, heads, tails, short, long)


def marked(word: str, long: int = LONG) -> str:
    return "^" * (long - 1) + word + "$" * (long - 1)


def decompose(s: str, d: Dictionary) -> list[tuple[int, int]]:
    """(start, end) of the grams of a marked word."""
    out, last, n = [], 0, len(s)
    for p in range(n - d.short + 1):
        end = p + d.short
        for e in range(min(p + d.long, n), end, -1):
            if s[p:e] in d.grams:
                end = e
                break
        if end > last:
            out.append((p, end))
            last = end
    return out


def unaffected(s: str, grams: list[tuple[int, int]], d: Dictionary) -> Iterator[tuple[int, int, int]]:
    """(change of length, left, right) for every edit of the word between the marks.

    An edit leaves all grams that end at ``left`` or before, and all that start at ``right`` or
    after; 0 and the word's length stand for none.
    """
    n, reach, marks = len(s), range(d.short, d.long), d.long - 1
    left, right = [0] * (n + 1), [n] * (n + 1)  # nearest unaffected gram of an edit from i on, of one that ends at i
    for i in range(marks, n - marks + 1):
        from_ = min((i - k for k in reach if s[i - k : i] in d.heads), default=i)
        for p, e in grams:  # both grow from gram to gram
            if e > i or p >= from_:
                break
            left[i] = e
        upto = max((i + k for k in reach if s[i : i + k] in d.tails), default=i)
        for p, e in reversed(grams):
            if p < i or e <= upto:
                break
            right[i] = p
    for i in range(marks, n - marks + 1):
        yield 1, left[i], right[i]
        if i < n - marks:
            yield 0, left[i], right[i + 1]
            yield -1, left[i], right[i + 1]


def _hashes(s: str) -> tuple[list[int], list[int]]:
    """Hashes of s[:i] and of s[i:]."""
    before, after = [1], [1]
    for c in s:
        before.append((before[-1] * BASE + ord(c)) % PRIME)
    for c in reversed(s):
        after.append((after[-1] * BASE + ord(c)) % PRIME)
    return before, after[::-1]


def keys(word: str, d: Dictionary) -> tuple[set[int], set[int]]:
    """Keys under which a word is listed, and those that it asks for.

    A key stands for two grams (or the word's end in place of one) with everything outside
    them, and the length of the listed word.
    """
    s = marked(word, d.long)
    n, grams = len(s), decompose(s, d)
    before, after = _hashes(s)

    def key(e: int, p: int, length: int) -> int:
        return (before[e] * 0x9E3779B97F4A7C15 + after[p] * 0xC2B2AE3D27D4EB4F + length) % PRIME

    asked = {key(e, p, n + change) for change, e, p in unaffected(s, grams, d)}
    # Between the nearest unaffected grams of an edit lie no more characters than these, where one side has none and elsewhere.
    spread = d.long - d.short
    outer, inner = d.long + spread + 1, 2 * spread + 1
    ends, starts = [0, *[e for _, e in grams if e < n]], [*[p for p, _ in grams if p], n]
    listed = {key(e, p, n) for e in ends for p in starts if 0 <= p - e <= (inner if e and p < n else outer)}
    return listed, asked


def bound(word: str, d: Dictionary) -> int:
    """How many grams of a word an edit leaves at least."""
    s = marked(word, d.long)
    grams = decompose(s, d)
    return min(sum(e <= left or p >= right for p, e in grams) for _, left, right in unaffected(s, grams, d))


def _gram_counts(short: int, long: int):
    def count(batches):
        for batch in batches:
            n = Counter(s[p : p + q] for w in batch.column(0).to_pylist() for s in [marked(w, long)] for q in range(short, long + 1) for p in range(len(s) - q + 1))
            yield pa.RecordBatch.from_pydict({"gram": pa.array(n.keys(), pa.string()), "n": pa.array(n.values(), pa.int64())})

    return count


def dictionary(words: DataFrame, short: int = SHORT, long: int = LONG, share: int = SHARE) -> Dictionary:
    """The gram dictionary of ``words`` (word).

    Of each length fewer than ``share`` grams hold more than that part of all places, so at most
    ``share`` times the alphabet's size grams of the next length come to the driver.
    """
    counts = words.select("word").mapInArrow(_gram_counts(short, long), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = cut(counts.withColumn("q", F.length("gram")), "grams")
    places = counts.where(F.col("q") == short).agg(F.sum("n")).first()[0] or 0
    frequent = counts.where((F.col("q") < long) & (F.col("n") * share > places)).select(F.col("gram").alias("head"))
    longer = counts.where(F.col("q") > short).withColumn("head", F.expr("substring(gram, 1, q - 1)"))
    kept = longer.join(frequent, "head", "left_semi").select("gram")
    return dictionary_of((r["gram"] for r in kept.toLocalIterator()), short, long)


def _keys(held):
    def rows(batches):
        d = dictionary_of(*held.value)
        ids, at, asks = [], [], []

        def block():
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(asks, pa.bool_())], ["id", "key", "asks"])

        for batch in batches:
            for i, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for asking, found in enumerate(keys(word, d)):
                    at += found
                    ids += [i] * len(found)
                    asks += [bool(asking)] * len(found)
                if len(at) >= ROWS:
                    yield block()
                    ids, at, asks = [], [], []
        if at:
            yield block()

    return rows


def near_pairs(words: DataFrame, d: Dictionary) -> DataFrame:
    """(a, b) ids, a < b, of ``words`` (id, word) that differ by one code point inserted, deleted or replaced."""
    held = words.sparkSession.sparkContext.broadcast((list(d.grams), d.short, d.long))
    keyed = cut(words.select("id", "word").mapInArrow(_keys(held), "id long, key long, asks boolean"), "gram-keys")
    asked = keyed.where("asks").select(F.col("id").alias("x"), "key")
    listed = keyed.where("not asks").select(F.col("id").alias("y"), "key")
    met = asked.join(listed.hint("merge"), "key").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    left, right = words.select(F.col("id").alias("a"), F.col("word").alias("u")), words.select(F.col("id").alias("b"), F.col("word").alias("v"))
    spelled = met.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return spelled.where(F.levenshtein("u", "v", 1) == 1).select("a", "b")


def vocabulary(occurrences: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(id, word, n) of the distinct ``word`` values that are long and frequent enough."""
    counted = occurrences.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    return cut(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of ``forms`` (id, form): where the forms lead; every turn doubles the steps taken."""
    at = cut(forms.select("id", F.coalesce("form", "id").alias("root")), "roots")
    while True:
        to = at.select(F.col("id").alias("of"), F.col("root").alias("next"))
        at = cut(at.join(to, F.col("root") == F.col("of")).select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.select("id", "root")
        at = at.drop("moved")


def groups(words: DataFrame, short: int = SHORT, long: int = LONG, share: int = SHARE, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of ``words`` (id, word, n; see ``vocabulary``).

    ``form`` is the most frequent near word (the smallest in code-point order of equal ones) if it
    occurs at least ``factor`` times as often, ``root`` where the forms lead. Frequencies grow along
    the way, so it ends.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more")
    pairs = cut(near_pairs(words, dictionary(words, short, long, share)), "near")
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    known = words.select(F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("word").alias("other_word"))
    best = both.join(known, "other").groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("other_n"), "other_word", "other")).alias("best"))
    best = best.select(F.col("id").alias("of"), "n_near", F.col("best.other").alias("to"), F.col("best.other_word").alias("to_word"), (-F.col("best.col1")).alias("to_n"))
    enough = F.col("to_n") >= F.col("n") * factor
    joined = words.join(best, F.col("id") == F.col("of"), "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *[F.when(enough, F.col(c)).alias(name) for c, name in (("to", "to"), ("to_word", "form"), ("to_n", "form_n"))],
    )
    joined = cut(joined, "forms")
    led = roots(joined.select("id", F.col("to").alias("form"))).where("id != root").select(F.col("id").alias("of"), F.col("root").alias("last"))
    last = words.select(F.col("id").alias("last"), F.col("word").alias("root"))
    named = led.join(last, "last").select("of", "root")
    out = joined.join(named, F.col("id") == F.col("of"), "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def lowered(run: Column) -> Column:
    """``run`` with A-Z in lower case; other letters stay."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def occurrences(docs: DataFrame, typo: int | None = None) -> DataFrame:
    """(word): every maximal run of letters of the whole texts, A-Z in lower case; null texts have none.

    With ``typo``, a run whose CRC-32 with its doc_id is divisible by it loses the code point that the
    CRC-32 points to; a row without doc_id keeps its runs.
    """
    runs = docs.select(F.col("doc_id").cast("string").alias("doc"), F.explode(F.split("text", NOT_LETTERS)).alias("run")).where("run != ''")
    words = runs.select("doc", lowered(F.col("run")).alias("word"))
    if typo is None:
        return words.select("word")
    marks = words.select("word", F.crc32(F.concat_ws(":", "doc", "word").cast("binary")).alias("h"), F.col("doc").isNotNull().alias("named"))
    at = (F.col("h") % F.length("word")).cast("int")
    less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return marks.select(F.when(F.col("named") & (F.col("h") % typo == 0), less).otherwise(F.col("word")).alias("word"))


def op12_spelling(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per word of the corpus's vocabulary."""
    found = groups(vocabulary(occurrences(docs, TYPO)))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


OP12_SQL = """
WITH crc_table AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY n) AS t
  FROM (SELECT unnest(generate_series(0, 255))::BIGINT AS n)),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
hexed AS (SELECT *, hex(encode(doc_id || ':' || w)) AS x FROM runs),
hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
    lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) AS h FROM hexed, crc_table),
typed AS (SELECT CASE WHEN h % 97 = 0 THEN w[:h % len(w)] || w[h % len(w) + 2:] ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS (SELECT word, n, i, word[:i - 1] || '?' || word[i + 1:] AS hole, word[:i - 1] || word[i + 1:] AS less
  FROM (SELECT *, unnest(generate_series(1, len(word))) AS i FROM words)),
less AS (SELECT DISTINCT word, n, less FROM holes),
pairs AS (
  SELECT a.word AS u, b.word AS v, b.n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word != b.word
  UNION SELECT less.word, words.word, words.n FROM less JOIN words ON less.less = words.word
  UNION SELECT words.word, less.word, less.n FROM less JOIN words ON less.less = words.word),
near AS (SELECT u, count(DISTINCT v) AS n_near, arg_min(v, (-n, v)) AS best, max(n) AS best_n FROM pairs GROUP BY u),
formed AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
  FROM words LEFT JOIN near ON u = word),
ways AS (
  WITH RECURSIVE way AS (
    SELECT word, coalesce(form, word) AS at FROM formed
    UNION
    SELECT way.word, formed.form FROM way JOIN formed ON formed.word = way.at WHERE formed.form IS NOT NULL)
  SELECT way.word, way.at AS root FROM way JOIN formed ON formed.word = way.at WHERE formed.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ways USING (word)
"""
