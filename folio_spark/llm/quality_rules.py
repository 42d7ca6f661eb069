"""Quality rules: a threshold table compiled into one projection, without user functions.

A rule bounds the ratio of two measures of a text, in hundredths:
``low * denominator <= 100 * numerator <= high * denominator``. Both sides are whole numbers, so
a verdict is exact wherever it is computed, and a denominator of zero passes. The table is data:
``verdicts`` takes any list of rules over ``MEASURES`` and makes it one struct of counts and one
list of broken rules per row. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, sql_text

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 3  # words of a window that counts as repeated
PLACE_BITS = 31  # of a packed window; a text has fewer words

# Frequent function words of the corpus languages (fixed values).
STOP_WORDS = {
    "en": "the of and to in that is for was with as on be by this are it at an or from not",
    "de": "der die das und ist nicht mit von zu ein eine den für im auf",
    "fr": "le la les de et un une est que dans pour qui sur",
    "es": "el los las y en por con del se no al una",
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


class Rule(NamedTuple):
    """``numerator`` over ``denominator`` lies between ``low`` and ``high`` hundredths (None: open).

    Without a denominator the bounds are plain counts. ``base`` marks the rules that decide
    before all others do.
    """

    name: str
    numerator: str
    denominator: str | None
    low: int | None
    high: int | None
    base: bool = False


RULES = (
    Rule("few_words", "n_words", None, 50, None, base=True),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 50, base=True),
    Rule("word_length", "word_chars", "n_words", 300, 1000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 6, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 40),
    Rule("short_lines", "n_lines", "n_words", None, 50),
)


def rules_of(table: DataFrame, most: int = 1000) -> list[Rule]:
    """The rules of a table with the columns of ``Rule``; more than ``most`` rows are refused."""
    rows = table.select(*Rule._fields).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return [Rule(**r.asDict()) for r in rows]


def _letters_left(text: Column, without: str) -> Column:
    return F.length(F.regexp_replace(text, without, "")).cast("long")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def _with_equal(at: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Elements of a sorted array that are the ``same`` as a neighbour."""
    alike = lambda x, y: F.coalesce(same(x, y), F.lit(False))
    return F.filter(at, lambda x, i: alike(x, F.get(at, i - 1)) | alike(x, F.get(at, i + 1)))


def repeated(words: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a window found twice or more, first occurrences included.

    Each window is one long, hash bits above its place; sorted, possibly equal windows are
    neighbours. Only those are spelled out and compared as strings, so the hash decides nothing.
    """
    n = F.size(words) - window + 1

    def hashed(i: Column) -> Column:
        return F.shiftleft(F.xxhash64(*[F.get(words, i + k) for k in range(window)]), PLACE_BITS).bitwiseOR(i.cast("long"))

    def spelled(p: Column) -> Column:
        i = p.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
        return let(i, lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + k) for k in range(window)]).alias("g"), i.alias("i")))

    def places(packed: Column) -> Column:
        near = _with_equal(packed, lambda x, y: F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS))
        placed = let(near, lambda c: F.array_sort(F.transform(c, spelled)))
        again = let(placed, lambda at: F.transform(_with_equal(at, lambda x, y: x["g"] == y["g"]), lambda x: x["i"]))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.sequence(i, i + window - 1)))))

    return F.when(n < 2, 0).otherwise(let(F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), hashed)), places)).cast("long")


def measures(text: Column, stop_words: list[str]) -> Column:
    """One struct with all MEASURES of a text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))

    def of_words(ws: Column) -> Column:
        lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD))
        counts = let(lines, lambda held: F.struct(F.size(held).cast("long").alias("n"), (F.size(held) - F.size(F.array_distinct(held))).cast("long").alias("dup")))
        return let(
            counts,
            lambda c: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                _letters_left(whole, rf"[^{SYMBOLS[1:]}+").alias("n_symbols"),
                F.size(F.filter(ws, lambda w: F.lower(w).isin(stop_words))).cast("long").alias("n_stop_words"),
                c["n"].alias("n_lines"),
                c["dup"].alias("n_dup_lines"),
                repeated(ws).alias("n_repeat_words"),
            ),
        )

    return let(words_of(whole), of_words)


def broken(rule: Rule, at: Column) -> Column:
    """True where the measures ``at`` break ``rule``; never null."""
    for name in (rule.numerator, rule.denominator):
        if name is not None and name not in MEASURES:
            raise ValueError(f"unknown measure {name!r} in rule {rule.name!r}")
    value = at[rule.numerator] * F.lit(1 if rule.denominator is None else 100)
    unit = F.lit(1).cast("long") if rule.denominator is None else at[rule.denominator]
    bad = F.lit(False)
    if rule.low is not None:
        bad = bad | (value < unit * F.lit(rule.low))
    if rule.high is not None:
        bad = bad | (value > unit * F.lit(rule.high))
    return bad


def verdict(text: Column, rules: Sequence[Rule] = RULES, stop_words: Iterable[str] | None = None) -> Column:
    """struct(MEASURES, base_failed, kept, broken: names of broken rules in the table's order)."""
    words = " ".join(STOP_WORDS.values()).split() if stop_words is None else list(stop_words)

    def judged(m: Column) -> Column:
        names = F.filter(F.array(*[F.when(broken(r, m), F.lit(r.name)) for r in rules], F.lit(None).cast("string")), lambda x: x.isNotNull())
        based = F.expr("array(" + ", ".join(sql_text(r.name) for r in rules if r.base) + ")").cast("array<string>")
        return let(
            names,
            lambda b: F.struct(
                *[m[k].alias(k) for k in MEASURES], F.arrays_overlap(b, based).alias("base_failed"), (F.size(b) == 0).alias("kept"), b.alias("broken")
            ),
        )

    return let(measures(text, words), judged)


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, stop_words: Iterable[str] | None = None, out: str = "quality") -> DataFrame:
    """``docs`` with the struct of :func:`verdict` in the column ``out`` (replaced if it exists).

    Null and empty texts have no words and break the word count. Repeated rows get equal answers,
    very long texts are judged whole, and an empty table stays empty.
    """
    return docs.withColumn(out, verdict(F.col("text"), rules, stop_words))


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES, stop_words: Iterable[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that break no rule, with their own columns."""
    return docs.where(verdict(F.col("text"), rules, stop_words)["kept"])


def op13_quality(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the names of the broken rules."""
    at = docs.select("doc_id", F.explode(F.array(verdict(F.col("text")))).alias("q"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return at.select("doc_id", *[F.col(f"q.{n}").alias(n) for n in names], F.array_join("q.broken", ",").alias("broken"))


def _sql_rule(r: Rule) -> str:
    times, unit = ("", "1") if r.denominator is None else ("100 * ", r.denominator)
    sides = [f"{times}{r.numerator} < {r.low} * {unit}"] * (r.low is not None) + [f"{times}{r.numerator} > {r.high} * {unit}"] * (r.high is not None)
    return f"CASE WHEN {' OR '.join(sides)} THEN '{r.name}' END"


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(" ".join(STOP_WORDS.values()).split())))
OP13_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
words AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
grams AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words WHERE len(w) > 3)),
twice AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM texts),
dups AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dups.dup, 0)::BIGINT AS n_dup_lines, coalesce(dups.n, 0)::BIGINT AS n_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words
  FROM words LEFT JOIN covered USING (r) LEFT JOIN dups USING (r)),
judged AS (SELECT *, list_filter([{', '.join(map(_sql_rule, RULES))}], lambda x: x IS NOT NULL) AS b FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  list_has_any(b, [{', '.join(f"'{r.name}'" for r in RULES if r.base)}]) AS base_failed, len(b) = 0 AS kept, array_to_string(b, ',') AS broken
FROM judged
"""
