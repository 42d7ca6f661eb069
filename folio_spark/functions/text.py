"""Text, title, date, number and phone rules as native ``Column`` expressions.

Blank is ``""`` on the way in and out. Every pattern goes through :func:`rx`, so
white space, digits and word boundaries follow Unicode, not ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V

WS = r"[\s\x1c-\x1f]"
# All of it but the plain space, spelled out: Unicode classes make the hottest patterns several times slower.
NOT_PLAIN = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# White space that is not already one plain space, so that tidy text is left untouched.
UNTIDY = rf"[{NOT_PLAIN}][ {NOT_PLAIN}]*| [ {NOT_PLAIN}]+"
LABEL_NOISE = rf"[ {NOT_PLAIN}:：·ㆍ\-_/\[\]()]"
# Letters beyond ASCII whose capitals hold a letter of it.
PLAIN_CAPITALS = "".join(rf"\u{n:04x}" for n in range(0x80, 0x10000) if not 0xD800 <= n < 0xE000 and any(x.isascii() for x in chr(n).upper()))
FORMAT_STARTS = "".join(sorted({f[0] for f in V.FORMATS}))
# No letter beyond ASCII counts as one of these first ones in another case.
BLOCK_WORDS = rf"(?=[{''.join(sorted({c for w in V.BLOCK_PATTERN_WORDS.split('|') for c in (w[0].lower(), w[0].upper())}))}])(?iU:{V.BLOCK_PATTERN_WORDS})"
# What a status pattern of a title removes holds one of these; no letter beyond ASCII counts as theirs in another case.
STATUS_WORD = "(?i)new|update|업데이트"
FILENAME_NOISE = r'[\\/:*?"<>|]'


def rx(pattern: str, ignore_case: bool = False) -> str:
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for a body that mentions it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def where_once(df: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """Filter on computed columns without computing them a second time.

    A plain filter is moved below the projection and repeats its expressions there; that is
    right for cheap columns and wrong for extracted ones.
    """
    return df.select(F.inline(F.filter(F.array(F.struct(*df.columns)), keep)))


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def word_array(words: list[str]) -> Column:
    """Constant array; one small node in the plan however long the list is."""
    return F.expr("array(" + ", ".join(map(sql_text, words)) + ")")


def one_of(words: list[str], longest_first: bool = False) -> str:
    """Pattern of any of the words. Most places of a text are passed over by their first character alone."""
    first = "".join(sorted({literal(w[0]) for w in words}))
    return f"(?=[{first}])(?:{'|'.join(map(literal, sorted(words, key=len, reverse=True) if longest_first else words))})"


def first_said(words: list[str], text: Column) -> Column:
    """The first of the words, in their order, that a text contains, else null; one pass over texts without any."""
    said = F.get(F.filter(word_array(words), lambda w: F.contains(text, w)), F.lit(0))
    return F.when(text.rlike(one_of(words)), said)


def any_of(words: list[str], text: Column) -> Column:
    return let(text, lambda t: F.exists(word_array(words), lambda w: F.contains(t, w)))


def is_in(text: Column, words: list[str]) -> Column:
    return F.array_contains(word_array(words), text)


def filled(value: Column) -> Column:
    """The value, null when blank. Computed once, unlike ``nullif``, which repeats its input."""
    return let(value, lambda v: F.when(v != "", v))


def first_filled(*values: Column) -> Column:
    """First value that is not blank, else ``""``; later ones are only computed when needed."""
    return F.coalesce(*[filled(v) for v in values], F.lit(""))


def erase(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(text, rx(pattern, ignore_case), "")


def literal(text: str) -> str:
    """Escape for a Java pattern (``re.escape`` leaves no construct Java reads differently)."""
    return re.escape(text)


def _py_norm(word: str) -> str:
    return re.sub(LABEL_NOISE, "", " ".join(word.split()))


def norm_words(words: list[str]) -> list[str]:
    return list(dict.fromkeys(_py_norm(w) for w in words))


# --- D1-D3 ---------------------------------------------------------------------
def clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), UNTIDY, " "))


def is_blank(c: Column) -> Column:
    """``clean_text(c) == ""`` without cleaning: stops at the first visible character."""
    return ~F.coalesce(c.rlike(rx(r"[^\s\x1c-\x1f]")), F.lit(False))


def norm_key(c: Column) -> Column:
    """Text without label noise, which is all white space and more, so there is nothing to clean first."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), LABEL_NOISE, "")


def clean_filename(c: Column) -> Column:
    safe = clean_text(F.regexp_replace(clean_text(c), FILENAME_NOISE, "_"))
    return first_filled(safe, F.lit(V.UNNAMED))


# --- D4-D8 titles --------------------------------------------------------------
def _cut_at_marker(s: Column) -> Column:
    hits = F.filter(F.transform(word_array(V.TITLE_CUT_MARKERS), lambda m: F.position(m, s)), lambda p: p > 1)
    return F.substring(s, F.lit(1), F.coalesce(F.array_min(hits) - 1, F.length(s)))


def clean_dataset_title(c: Column, unwrap: bool = True) -> Column:
    """Bare dataset title. ``unwrap=False`` is the counts report's narrower rule."""
    head, tail = [V.TITLE_STATUS_HEAD, V.TITLE_STATUS_TAIL, V.TITLE_NEW_ANYWHERE], [V.TITLE_STATUS_TAIL] if unwrap else []

    def bare(patterns: list[str], t: Column) -> Column:
        return reduce(lambda x, p: erase(x, p, True), patterns, t)

    def portal_cut(t: Column) -> Column:
        return F.when(t.contains(V.TITLE_PORTAL), erase(t, V.TITLE_PORTAL_TAIL)).otherwise(t)

    def stripped(t: Column) -> Column:
        # Most titles have none of the status words, in any case, and nothing to search for.
        told = let(let(bare(head, t), _cut_at_marker), lambda x: bare(tail, x))
        return F.when(t.rlike(STATUS_WORD), told).otherwise(_cut_at_marker(t))

    s = clean_text(let(let(erase(clean_text(c), V.TITLE_BADGES, True), stripped), portal_cut))
    if not unwrap:
        return s
    return let(
        s,
        lambda t: F.when(
            t.rlike(V.TITLE_WRAPPED), F.trim(F.substring(t, F.lit(2), F.length(t) - 2))
        ).otherwise(t),
    )


def strip_date_suffix(c: Column) -> Column:
    return clean_text(erase(clean_dataset_title(c), V.TITLE_DATE_TAIL))


def title_for_compare(c: Column) -> Column:
    return F.lower(erase(strip_date_suffix(c), WS + "+"))


def is_menu_title(c: Column) -> Column:
    """True for blank text, portal menu words and two long menu phrases."""
    return let(
        clean_text(c),
        lambda t: (t == "") | any_of(V.MENU_PHRASES, t) | is_in(erase(t, LABEL_NOISE), norm_words(V.MENU_WORDS)),
    )


def list_title(title: Column, raw_title: Column) -> Column:
    cleaned = F.transform(F.array(title, raw_title), lambda c: clean_dataset_title(c))
    return F.coalesce(F.get(F.filter(cleaned, lambda t: ~is_menu_title(t)), F.lit(0)), F.lit(""))


def chosen_title(listed: Column, title_source: Column, fallback: Column) -> Column:
    """Listing title, corrected by the detail title unless the anchor itself gave it."""
    trusted = is_in(clean_text(title_source), ["anchor", "detail_anchor"])
    detail = let(strip_date_suffix(fallback), lambda t: F.when(is_menu_title(t), "").otherwise(t))

    def differs(d: Column) -> Column:
        a, b = (F.transform(F.array(listed, d), lambda t: title_for_compare(t))[i] for i in (0, 1))
        return a != b

    corrected = let(detail, lambda d: F.when((d != "") & differs(d), d).otherwise(listed))
    return F.when(listed == "", detail).when(trusted, listed).otherwise(corrected)


def dataset_title(title: Column, raw_title: Column, title_source: Column, fallback: Column) -> Column:
    return let(list_title(title, raw_title), lambda listed: chosen_title(listed, title_source, fallback))


# --- D11, D13 --------------------------------------------------------------------
def is_short_html_error(c: Column) -> Column:
    return any_of(V.SHORT_HTML_SIGNALS, F.coalesce(c, F.lit("")))


def detect_formats(c: Column) -> Column:
    """File formats named in the text, in the fixed order; one pass over the text.

    Cleaning first would change nothing: it only touches white space between words. Only a text that
    holds a name, or one of the few letters whose capitals are plain ones, is put in capitals at all.
    """
    names = "|".join(sorted(V.FORMATS, key=len, reverse=True))
    words = F.regexp_extract_all(F.upper(c), F.lit(rx(rf"(?=[{FORMAT_STARTS}])\b(?:{names})\b")), F.lit(0))
    held = c.rlike(rf"(?i)(?=[{FORMAT_STARTS}{PLAIN_CAPITALS}])(?:{names}|[{PLAIN_CAPITALS}])")
    return F.array_intersect(word_array(V.FORMATS), F.when(held, words).otherwise(F.array().cast("array<string>")))


# --- D15-D20 numbers ---------------------------------------------------------------
def labelled_value(c: Column, label: str, longest: int | None = V.CARD_VALUE_CHARS) -> Column:
    """Text behind a card label, up to the next one; blank if over ``longest`` characters (None: any length)."""
    others = "|".join(literal(x) for x in V.CARD_VALUE_LABELS if x != label)
    pattern = rf"{literal(label)}\s*[:：]?\s*(.*?)(?=(?:{others})\s*[:：]?|$)"
    value = clean_text(F.regexp_extract(clean_text(c), rx(pattern), 1))
    return value if longest is None else let(value, lambda v: F.when(F.length(v) > longest, "").otherwise(v))


def _bare(c: Column) -> Column:
    return F.replace(c, F.lit(","))


def count_after_label(c: Column, labels: list[str]) -> Column:
    text = clean_text(c)
    patterns = [literal(label).replace(r"\ ", r"\s*") + tail for label in labels for tail in V.COUNT_AFTER_LABEL]
    return _bare(first_filled(*[F.regexp_extract(text, rx(p, True), 1) for p in patterns]))


def _count_pair(text: Column) -> Column:
    phrase = first_filled(*[F.regexp_extract(text, rx(p, True), 0) for p in V.COUNT_PAIR_PATTERNS])
    return F.regexp_extract_all(phrase, F.lit("[0-9][0-9,]*"), F.lit(0))


def card_counts(c: Column) -> Column:
    """struct(views, downloads) as digit strings, blank when absent."""
    return let(
        clean_text(c),
        lambda t: let(
            _count_pair(t),
            lambda pair: F.struct(
                F.coalesce(_bare(F.get(pair, F.lit(0))), count_after_label(t, V.VIEW_LABELS)).alias("views"),
                F.coalesce(_bare(F.get(pair, F.lit(1))), count_after_label(t, V.DOWNLOAD_LABELS)).alias("downloads"),
            ),
        ),
    )


def card_counts_int(c: Column) -> Column:
    """struct(views, downloads) as longs, 0 when absent; accepts the looser labels."""

    def number(found: Column, text: Column, pattern: str) -> Column:
        loose = filled(F.regexp_extract(text, rx(pattern), 1))
        return F.coalesce(_bare(F.coalesce(found, loose)).try_cast("long"), F.lit(0).cast("long"))

    return let(
        clean_text(c),
        lambda t: let(
            _count_pair(t),
            lambda pair: F.struct(
                number(F.get(pair, F.lit(0)), t, V.LOOSE_VIEW_PATTERN).alias("views"),
                number(F.get(pair, F.lit(1)), t, V.LOOSE_DOWNLOAD_PATTERN).alias("downloads"),
            ),
        ),
    )


def only_digits(c: Column) -> Column:
    return let(
        clean_text(c),
        lambda t: F.when(t.rlike(rx(r"[\d,]+")), _bare(F.regexp_extract(t, rx(r"[\d,]+"), 0))).otherwise(t),
    )


def only_int(c: Column) -> Column:
    found = _bare(F.regexp_extract(clean_text(c), r"[0-9][0-9,]*", 0))
    return F.coalesce(found.try_cast("long"), F.lit(0).cast("long"))


def progress_int(c: Column, default: int = 0) -> Column:
    digits = F.trim(_bare(c.cast("string")))
    return F.coalesce(F.when(digits.rlike(r"^[+-]?[0-9]+$"), digits.try_cast("long")), F.lit(default).cast("long"))


# --- D21 dates ---------------------------------------------------------------------
def normalize_date(c: Column) -> Column:
    def iso(t: Column) -> Column:
        part = [F.regexp_extract(t, rx(V.DATE_PATTERN), i) for i in (1, 2, 3)]
        return F.when(
            t.rlike(rx(V.DATE_PATTERN)), F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0"))
        ).otherwise(t)

    return let(clean_text(c), iso)


# --- D22 blocked responses -----------------------------------------------------------
def block_signal(c: Column, chars: int | None = V.BLOCK_HEAD) -> Column:
    """struct(blocked, signal): first error-page phrase or pattern in the first ``chars`` of clean text (None: all of it)."""

    def first_signal(head: Column) -> Column:
        phrase = first_said(V.BLOCK_PHRASES, head)
        # Each pattern asks for one of the hints, and is only tried where that stands.
        tried = [F.when(head.contains(next(h for h in V.BLOCK_PATTERN_HINTS if h in p)) & head.rlike(rx(p, True)), F.lit(p)) for p in V.BLOCK_PATTERNS]
        return F.coalesce(phrase, F.when(any_of(V.BLOCK_PATTERN_HINTS, head) & head.rlike(BLOCK_WORDS), F.coalesce(*tried)), F.lit(""))

    head = c if chars is None else F.substring(c, 1, chars)
    return let(let(head, first_signal), lambda s: F.struct((s != "").alias("blocked"), s.alias("signal")))


# --- D23-D25 phones --------------------------------------------------------------------
def phone_number(c: Column) -> Column:
    def found(t: Column) -> Column:
        hit = first_filled(*[F.regexp_extract(t, rx(p), 0) for p in V.PHONE_PATTERNS])
        dashed = F.translate(erase(hit, WS + "+"), ".)", "--")
        return F.regexp_replace(F.regexp_replace(dashed, "-+", "-"), "^-|-$", "")

    # Every pattern asks for a digit, which most texts lack.
    return let(F.coalesce(c.cast("string"), F.lit("")), lambda t: F.when(t.rlike(rx(r"\d")), let(clean_text(t), found)).otherwise(""))


def is_portal_phone(c: Column) -> Column:
    return let(clean_text(c), lambda t: any_of(V.PORTAL_TERMS, t) & (phone_number(t) == V.PORTAL_PHONE))


def phone_after_label(c: Column) -> Column:
    """Phone (or raw text) behind a phone label in running text."""
    stop = "|".join(literal(x) for x in sorted(V.PHONE_STOP_LABELS, key=len, reverse=True))
    pattern = rf"(?:{V.PHONE_LABEL_PATTERN})\s*[:：]?\s*(.*?)(?=(?:{stop})\s*[:：]?|$)"
    value = clean_text(F.regexp_extract(clean_text(c), rx(pattern, True), 1))
    return let(value, lambda v: first_filled(phone_number(v), v))


def format_tel_no(c: Column) -> Column:
    def grouped(d: Column) -> Column:
        def cut(*sizes: int) -> Column:
            starts = [1 + sum(sizes[:i]) for i in range(len(sizes))]
            return F.concat_ws("-", *[F.substring(d, s, n) for s, n in zip(starts, sizes)])

        n = F.length(d)
        return (
            F.when(n == 8, cut(4, 4))
            .when(n == 9, cut(2, 3, 4))
            .when((n == 10) & d.startswith("02"), cut(2, 4, 4))
            .when(n == 10, cut(3, 3, 4))
            .when(n == 11, cut(3, 4, 4))
            .otherwise(d)
        )

    return let(erase(F.coalesce(c.cast("string"), F.lit("")), r"\D"), grouped)


# --- D26-D29 names, clocks, percents -----------------------------------------------------
def org_variations(c: Column) -> Column:
    """Ordered distinct spellings an organisation may be registered under."""

    def forms(b: Column) -> Column:
        tight = F.replace(b, F.lit(" "))
        spelled = [
            b, tight, F.concat(b, F.lit("㈜")), F.concat(b, F.lit("(주)")), F.concat(F.lit("㈜"), b),
            F.concat(F.lit("(주)"), b), F.replace(b, F.lit("(주)"), F.lit("㈜")), F.replace(b, F.lit("㈜"), F.lit("(주)")),
            F.concat(tight, F.lit("㈜")), F.concat(tight, F.lit("(주)")), F.concat(b, F.lit("(재)")),
            F.concat(F.lit("(재)"), b), F.concat(tight, F.lit("(재)")),
        ]
        return F.array_distinct(F.filter(F.array(*[clean_text(s) for s in spelled]), lambda v: v != ""))

    return let(clean_text(c), forms)


def fmt_elapsed(seconds: Column) -> Column:
    s = F.floor(seconds.cast("double")).cast("long")
    hours, minutes, rest = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(hours > 0, F.format_string("%02d:%02d:%02d", hours, minutes, rest)).otherwise(
        F.format_string("%02d:%02d", minutes, rest)
    )


def clamp_percent(c: Column) -> Column:
    """Whole percent in 0..100; text that is not an integer counts as 0."""
    text = F.trim(c.cast("string"))
    number = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("double"))
    return F.coalesce(F.least(F.greatest(number, F.lit(0.0)), F.lit(100.0)), F.lit(0.0)).cast("long")


def safe_org_name(c: Column) -> Column:
    return F.translate(c, "()", "_")


def sheet_name(base: Column, idx: Column | None = None) -> Column:
    """Name of an output chunk, at most 31 characters including its number."""
    name = F.regexp_replace(first_filled(clean_text(base), F.lit(V.SHEET_DEFAULT)), r"[/?*\[\]:]", "_")
    if idx is None:
        return F.substring(name, 1, V.SHEET_NAME_CHARS)
    suffix = F.format_string("_%03d", idx)
    return F.concat(F.substring(name, F.lit(1), F.lit(V.SHEET_NAME_CHARS) - F.length(suffix)), suffix)
