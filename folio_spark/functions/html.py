"""Markup with native string functions: visible text, character references, attributes, tag patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, filled, let, sql_text, word_array

# A script without markup of its own stays for the phone look-up; any other goes.
HIDDEN = (
    r"(?is)<(?:!--.*?(?:-->|\z)|(style|template)\b[^>]*>.*?(?:</\1\s*>|\z)|"
    r"script\b[^>]*>(?![^<]*</script).*?(?:</script\s*>|\z))"
)
PLAIN_SCRIPT = r"(?i)<script\b[^>]*>([^<]*)</script\s*>"
SHOWN_BREAK = r"(?i)<(?:script\b[^>]*>[^<]*</script\s*>|[a-zA-Z/!?][^>]*>)"
# Character references found on catalogue pages (fixed values).
NAMED = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "middot": "·",
    "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "bull": "•", "times": "×", "laquo": "«", "raquo": "»", "deg": "°", "trade": "™", "euro": "€", "amp": "&",
}
REFERENCE = r"^&(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([a-zA-Z]+));"


def unescape(c: Column) -> Column:
    """Decode character references, each exactly once."""
    names = F.expr("map(" + ", ".join(f"{sql_text(n)}, {sql_text(ch)}" for n, ch in NAMED.items()) + ")")

    def piece(p: Column) -> Column:
        number = F.coalesce(
            filled(F.regexp_extract(p, REFERENCE, 2)), F.hex(F.regexp_extract(p, REFERENCE, 1).try_cast("long"))
        )
        char = F.coalesce(
            F.try_element_at(names, F.regexp_extract(p, REFERENCE, 3)), F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32")
        )
        return F.when(p.startswith("&"), F.coalesce(F.concat(char, F.regexp_replace(p, REFERENCE, "")), p)).otherwise(p)

    return let(c, lambda t: F.when(t.contains("&"), F.array_join(F.transform(F.split(t, "(?=&)"), piece), "")).otherwise(t))


def visible(html: Column) -> Column:
    """Markup without comments, styles, templates and scripts that hold markup."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")


def text_of(markup: Column) -> Column:
    """Shown text of visible markup: tags and scripts become spaces, references are decoded."""
    return clean_text(unescape(F.regexp_replace(markup, SHOWN_BREAK, " ")))


def attribute(tag: Column, name: str) -> Column:
    raw = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return unescape(F.regexp_replace(raw, "^[\"']|[\"']$", ""))


def attributes(tag: Column, names: list[str]) -> Column:
    """Values of several attributes of a tag, in the order of ``names``; absent ones are left out."""
    pattern = F.lit(rf"(?is)\s({'|'.join(names)})\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
    found = F.struct(
        F.transform(F.regexp_extract_all(tag, pattern, F.lit(1)), lambda n: F.lower(n)).alias("n"),
        F.regexp_extract_all(tag, pattern, F.lit(2)).alias("v"),
    )
    values = let(
        found,
        lambda f: F.transform(word_array(names), lambda n: F.get(f["v"], F.array_position(f["n"], n).cast("int") - 1)),
    )
    return F.transform(
        F.filter(values, lambda v: v.isNotNull()), lambda v: unescape(F.regexp_replace(v, "^[\"']|[\"']$", ""))
    )


def inner(piece: Column) -> Column:
    return F.regexp_replace(piece, r"^<[^>]*>", "")


def _class_attr(name: str) -> str:
    return (
        rf"\sclass\s*=\s*(?:\"(?:[^\">]*\s)?{name}(?:\s[^\">]*)?\"|"
        rf"'(?:[^'>]*\s)?{name}(?:\s[^'>]*)?'|{name}(?=[\s>]))"
    )


def class_tag(tag: str, name: str) -> str:
    """Pattern of a whole opening tag that carries a class name."""
    return rf"(?is)<(?:{tag})\b[^>]*{_class_attr(name)}[^>]*>"


def id_tag(name: str) -> str:
    return rf"(?is)<[a-z][a-z0-9]*\b[^>]*\sid\s*=\s*[\"']?{name}[\"'\s>][^>]*>?"
