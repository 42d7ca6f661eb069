"""A page's element tree in columns: tokens decoded once, nodes as intervals over them.

``tree`` splits visible markup at its tags; each token keeps its raw text and the clean text
behind its tag. A stack of open elements (``markup_tree``, in Python over Arrow batches) gives every
element a node: its number in page order, the tokens it spans (``open`` to before ``stop``), the
number of its last descendant and its parent. Descendants of a node are the nodes behind it up to
``last``, so elements, children and siblings are slices and filters, and the text of any element is
a slice of texts that are already clean. The cells of every table's rows come with their texts and normal forms.

End tags that HTML lets an author leave out are closed by what follows (list items, cells, rows,
terms, options, paragraphs, links); end tags that match nothing open are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V
from .html import NAMED, inner
from .markup_tree import BLOCKS, INLINE, VOID, page_trees  # noqa: F401
from .text import LABEL_NOISE, clean_text, norm_words, word_array

TAG = r"^<[a-zA-Z/!?][^>]*>"
NODES = "array<struct<at:int,tag:string,open:int,stop:int,last:int,parent:int>>"
CELLS = "array<struct<tag:string,at:int,text:string,key:string,mark:int>>"
TABLES = f"array<array<struct<cells:{CELLS},paired:{CELLS},any:int,all:int>>>"
PARTS = {"raw": "array<string>", "text": "array<string>", "nodes": NODES, "tables": TABLES, "said": "array<string>", "shown": "string"}
# Groups of keys that the rules of column tables ask for: whether a cell is of one is known once for all its like.
KEY_GROUPS = {
    "name": V.HEADER_NAME_KEYS, "descr": V.HEADER_DESC_KEYS, "dtype": V.HEADER_TYPE_KEYS, "length": V.HEADER_LENGTH_KEYS, "extra": V.HEADER_EXTRA_KEYS,
    "skip": norm_words(V.COLUMN_SKIP_WORDS), "again": ["항목명"], "again_with": ["데이터타입", "항목설명"],
}
RUN_STARTS = "".join(sorted({run[0] for run in V.SUBHEADER_RUNS_LATE}))
MARKS = {"filled": 1, "run": 2} | {name: 4 << i for i, name in enumerate(KEY_GROUPS)}


def tree(markup: Column, *parts: str, words: tuple[str, ...] = ()) -> Column:
    """struct(raw, text, nodes, tables) of visible markup: the element tree of a page, or only ``parts`` of it.

    ``shown``, if asked for, is the page's text. With ``words``, ``said`` holds those that the page's text contains, as they stand or in capitals, so
    that rules whose words are absent need not search the text.
    """
    parts = (parts or ("raw", "text", "nodes", "tables")) + (("said",) if words else ())
    groups = tuple(map(tuple, KEY_GROUPS.values()))
    return F.arrow_udf(page_trees(NAMED, LABEL_NOISE, parts, words, groups, RUN_STARTS), f"struct<{','.join(f'{p}:{PARTS[p]}' for p in parts)}>")(markup)


def read(markup: Column) -> Column:
    """struct(raw, text) of the tokens of visible markup."""
    return tree(markup, "raw", "text")


def says(t: Column, words: list[str]) -> Column:
    """Whether a page's text holds one of the words, all of which ``tree`` was asked for."""
    return F.arrays_overlap(t["said"], word_array(words))


def marked(bits: Column, *names: str) -> Column:
    """Whether a mark, or the ``any`` or ``all`` of a row's, has one of some bits."""
    return bits.bitwiseAND(F.lit(sum(MARKS[n] for n in names))) != 0


def blank() -> Column:
    """The tree of a page without markup."""
    return F.struct(F.array(F.lit("")).alias("raw"), F.array(F.lit("")).alias("text"), F.array().cast(NODES).alias("nodes"), F.array().cast(TABLES).alias("tables"), F.lit("").alias("shown"), F.array().cast("array<string>").alias("said"))


def joined(texts: Column) -> Column:
    return F.array_join(F.filter(texts, lambda t: t != ""), " ")


def page_text(tokens: Column) -> Column:
    """Shown text of all tokens; equals ``html.text_of`` of the markup."""
    return joined(tokens["text"])


# --- queries over a tree -----------------------------------------------------------------
def span(items: Column, first: Column, last: Column) -> Column:
    """Elements ``first`` to ``last`` (from 0) of an array, read one by one: a slice would copy the whole array."""
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda i: F.get(items, i))).otherwise(F.slice(items, 1, 0))


def below(t: Column, node: Column) -> Column:
    """Descendants of a node, in page order."""
    return span(t["nodes"], node["at"] + 1, node["last"])


def tagged(nodes: Column, *tags: str) -> Column:
    return F.filter(nodes, lambda n: n["tag"].isin(*tags))


def children(t: Column, node: Column, *tags: str) -> Column:
    """Child elements of a node, of some tags or of all."""
    return F.filter(below(t, node), lambda n: (n["parent"] == node["at"]) & (n["tag"].isin(*tags) if tags else F.lit(True)))


def siblings_behind(t: Column, node: Column) -> Column:
    """Elements of the same parent that follow a node."""
    upto = F.when(node["parent"] >= 0, F.get(t["nodes"], node["parent"])["last"]).otherwise(F.size(t["nodes"]) - 1)
    return F.filter(span(t["nodes"], node["last"] + 1, upto), lambda n: n["parent"] == node["parent"])


def outermost(nodes: Column) -> Column:
    """Those of ``nodes`` (in page order) that lie in no other of them."""
    def step(s: Column, n: Column) -> Column:
        inside = n["at"] <= s["last"]
        return F.struct(F.when(inside, s["last"]).otherwise(n["last"]).alias("last"), F.when(inside, s["kept"]).otherwise(F.concat(s["kept"], F.array(n))).alias("kept"))

    return F.when(F.size(nodes) < 2, nodes).otherwise(F.aggregate(nodes, F.struct(F.lit(-1).alias("last"), F.array().cast(NODES).alias("kept")), step)["kept"])


def start_tag(t: Column, node: Column) -> Column:
    return F.regexp_extract(F.get(t["raw"], node["open"]), TAG, 0)


def matching(t: Column, nodes: Column, pattern: str) -> Column:
    """Nodes whose start tag matches a pattern of ``html.class_tag`` or ``html.id_tag``."""
    return F.filter(nodes, lambda n: F.get(t["raw"], n["open"]).rlike(rf"^(?:{pattern})"))


def raw_of(t: Column, node: Column) -> Column:
    """Markup inside a node."""
    return inner(F.array_join(span(t["raw"], node["open"], node["stop"] - 1), ""))


def text_of(t: Column, node: Column) -> Column:
    """Shown text of a node; of a script itself its content."""
    shown = F.when(node["stop"] - node["open"] == 1, F.get(t["text"], node["open"])).otherwise(joined(span(t["text"], node["open"], node["stop"] - 1)))
    return F.when(node["tag"] == "script", clean_text(raw_of(t, node))).otherwise(shown)
