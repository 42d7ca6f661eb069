"""The element tree of one page: tokens, their clean texts, and nodes by a stack of open elements.

The only Python of the page rules: a fold with a stack costs Spark's interpreted lambdas about ten
times as much. ``tree`` hands it whole batches and makes columns of what comes back. Pages of one
template repeat tokens and orders of tags, so a task remembers what it made of them, within bounds.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
# Elements whose start tag ends an open paragraph.
BLOCKS = [
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
]
INLINE = "a|abbr|b|big|cite|code|em|font|i|label|mark|s|small|span|strong|sub|sup|u|p"
# Elements that end each other share a name on the stack.
GROUP = {"td": "cell", "th": "cell", "dt": "term", "dd": "term", "thead": "section", "tbody": "section", "tfoot": "section"}
ENDED_BY_LIKE = {"li", "cell", "tr", "term", "section", "option", "a"}
# What may not stand between an open element and the tag that ends it.
FREE, IN_TABLE, IN_ROW, IN_CELL = (frozenset(x) for x in ((), ("table",), ("table", "tr"), ("table", "cell")))

FIRST = re.compile(r"<[a-zA-Z/!?]")
TOKEN = re.compile(r"<[a-zA-Z/!?][^<]*(?:<(?![a-zA-Z/!?])[^<]*)*")
STRAY = re.compile(r"<(?![a-zA-Z/!?])")
NAME = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*")
SCRIPT = re.compile(r"<script\b", re.IGNORECASE)
REFERENCE = re.compile(r"&(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([a-zA-Z]+));")
NODE = pa.struct([("at", pa.int32()), ("tag", pa.string()), *[(n, pa.int32()) for n in ("open", "stop", "last", "parent")]])
CELL = pa.struct([("tag", pa.string()), ("at", pa.int32()), ("text", pa.string()), ("key", pa.string())])
# What a task remembers: so many tokens or texts of so many characters, so many orders of so many tags.
KNOWN, KNOWN_CHARS, SHAPES, SHAPE_TAGS = 1 << 16, 80, 1 << 10, 1 << 10

_void, _blocks, _inline = set(VOID), set(BLOCKS), set(INLINE.split("|"))


def decoder(named: dict[str, str]):
    def char(m) -> str:
        if m[3]:
            return named.get(m[3], m[0])
        n = int(m[1]) if m[1] else int(m[2], 16)
        return chr(n) if n < 0xD800 or 0xE000 <= n <= 0x10FFFF else "�"

    return lambda text: REFERENCE.sub(char, text)


class Memo(dict):
    """Results of a function of one text; started anew when full, long texts are not kept."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, text: str):
        made = self.of(text)
        if len(text) <= KNOWN_CHARS:
            if len(self) >= KNOWN:
                self.clear()
            self[text] = made
        return made


def token_reader(decode):
    """Function from a raw token to its clean text and its name (``/name`` of end tags, blank without one)."""
    def read(token: str) -> tuple[str, str]:
        name, text = "", token
        if len(token) > 1 and token[0] == "<" and (token[1] in "/!?" or (token[1].isascii() and token[1].isalpha())):
            if m := NAME.match(token):
                name = m[0][1:].lower()
            end = token.find(">")
            if name == "script" and SCRIPT.match(token):
                text = ""
            elif end >= 0:
                text = token[end + 1 :]
        if "&" in text:
            text = decode(text)
        return " ".join(text.split()) if text else "", name

    return read


def raw_tokens(markup: str) -> list[str]:
    if STRAY.search(markup) is None:  # every ``<`` starts a token
        head, *behind = markup.split("<")
        raw = ["<" + piece for piece in behind]
        return [head, *raw] if head or not raw else raw
    first = FIRST.search(markup)
    if first is None:
        return [markup]
    raw = TOKEN.findall(markup, first.start())
    if first.start():
        raw.insert(0, markup[: first.start()])
    return raw


def nodes_of(names: list[str]) -> tuple[list, list, list, list, list]:
    """tag, open, stop, last, parent of every element, in page order.

    An element whose end tag comes next, or that has none, is closed at once; its end tag does
    nothing more. How many elements of a group are open is counted, so that most searches of the
    stack need not start; the others end at the first element that may not lie between.
    """
    tags, opens, stops, lasts, parents = [], [], [], [], []
    stack, count = [], {}
    size, before = len(names), None
    for i, name in enumerate(names):
        if not name:
            before = name
            continue
        closing = name[0] == "/"
        bare = name[1:] if closing else name
        if closing and before == bare:
            before = name
            continue
        before = name
        group = GROUP.get(bare, bare)
        ended = group if closing or group in ENDED_BY_LIKE else "p" if name in _blocks else None
        if ended is not None and count.get(ended):
            if group == "tr" or group == "section":
                bar = IN_TABLE
            elif group == "cell":
                bar = IN_TABLE if closing else IN_ROW
            elif closing and group == "table":
                bar = FREE
            elif closing and group not in _inline:
                bar = IN_CELL
            else:
                bar = None  # only inline elements may lie between
            at = len(stack) - 1
            while stack[at][0] != ended:
                if stack[at][0] not in _inline if bar is None else stack[at][0] in bar:
                    at = -1
                    break
                at -= 1
            if at >= 0:
                last = len(tags) - 1
                for g, k in stack[at:]:
                    stops[k], lasts[k] = i, last
                    count[g] -= 1
                del stack[at:]
        if closing:
            continue
        k = len(tags)
        tags.append(name)
        opens.append(i)
        parents.append(stack[-1][1] if stack else -1)
        lasts.append(k)
        if name in _void:
            stops.append(i)
        elif i + 1 < size and names[i + 1] == "/" + name:
            stops.append(i + 1)
        else:
            stops.append(size)
            stack.append((group, k))
            count[group] = count.get(group, 0) + 1
    for _, k in stack:
        lasts[k] = len(tags) - 1
    return tags, opens, stops, lasts, parents


def tables_of(tags: list[str], lasts: list[int], parents: list[int]) -> list[list[tuple[list[int], list[int]]]]:
    """Rows of every table as (own cells, all cells below), in page order; cells are nodes."""
    rows, cells = ([k for k, t in enumerate(tags) if t in group] for group in (("tr",), ("th", "td")))
    inside = {tr: cells[bisect_right(cells, tr) : bisect_right(cells, lasts[tr])] for tr in rows}
    sides = {tr: ([c for c in below if parents[c] == tr], below) for tr, below in inside.items()}
    return [[sides[tr] for tr in rows[bisect_right(rows, k) : bisect_right(rows, lasts[k])]] for k, t in enumerate(tags) if t == "table"]


def shape_of(names: tuple[str, ...]) -> tuple:
    """Nodes; their numbers; rows per table; and of a row's cells, twice, tags, nodes, token spans, sizes per row and,
    where every cell is one token, these.

    First a row's own cells, or all below it where it has none; then what pairs are made of where
    that is something else: all below a row of one cell.
    """
    found = nodes_of(list(names))
    tags, opens, stops, lasts, parents = found
    tables = tables_of(tags, lasts, parents)
    rows = [row for table in tables for row in table]
    sides = []
    for cells in ([own or below for own, below in rows], [below if len(own) == 1 else [] for own, below in rows]):
        flat = [c for row in cells for c in row]
        spans = [(opens[c], stops[c]) for c in flat]
        alone = [first for first, _ in spans] if all(stop - first == 1 for first, stop in spans) else None
        sides.append(([tags[c] for c in flat], flat, spans, [len(row) for row in cells], alone))
    return found, range(len(tags)), [len(table) for table in tables], [len(own) != 1 for own, _ in rows], sides


def page_trees(named: dict[str, str], noise: str = r"\s", parts: tuple[str, ...] = ("raw", "text", "nodes", "tables"), words: tuple[str, ...] = (), groups: tuple[tuple[str, ...], ...] = (), starts: str = ""):
    """Array function: markup to a struct of ``parts``; the key of a cell is its text without ``noise``.

    ``said`` are the ``words`` that the page's text holds as they stand or in capitals; ``shown`` is that text.
    With ``groups`` of keys a cell has a ``mark``: bit 0 if it has a text, bit 1 if its key holds a character of
    ``starts``, bit 2 + i if its key is of group i. A row has the bits of ``any`` of its cells and those of
    ``all`` that have a text (-1 where none has)."""
    decode = decoder(named)
    # A word without small letters is among the capitals if it stands there, one without capitals and small ones stands or does not.
    searched = [(w, w == w.upper(), w.lower() == w.upper()) for w in words]
    state = []
    cell_type = pa.struct([*CELL, ("mark", pa.int32())]) if groups else CELL

    def lists(sizes: list[int], values: pa.Array, gone: list[bool] | None = None) -> pa.Array:
        ends = pa.array([0, *accumulate(sizes)], pa.int32())
        return pa.ListArray.from_arrays(ends, values, mask=None if gone is None else pa.array(gone, pa.bool_()))

    def folded(fold: np.ufunc, marks: np.ndarray, sizes: np.ndarray, empty: int) -> np.ndarray:
        made = np.full(len(sizes), empty, np.int32)
        held = sizes > 0
        if held.any():
            made[held] = fold.reduceat(marks, (np.cumsum(sizes) - sizes)[held])
        return made

    def row_marks(marks: np.ndarray, sizes: list[int]) -> list[pa.Array]:
        n = np.array(sizes, np.int64)
        return [pa.array(folded(np.bitwise_or, marks, n, 0)), pa.array(folded(np.bitwise_and, np.where(marks & 1, marks, np.int32(-1)), n, -1))]

    def key_reader():
        strip = re.compile(noise).sub
        first = frozenset(starts)

        def read(text: str) -> tuple[str, int]:
            key = strip("", text)
            return key, (text != "") + (2 if not first.isdisjoint(key) else 0) + sum([4 << i for i, group in enumerate(groups) if key in group])

        return read

    def run(markup: pa.Array) -> pa.Array:
        if not state:
            state.extend([Memo(token_reader(decode)), Memo(key_reader()), {}])
        known, key_of, shapes = state
        all_shown, pick = [], "shown" in parts
        raw, texts, n_tokens, nodes, at, n_nodes = [], [], [], ([], [], [], [], []), [], []
        n_tables, n_rows, same, held, n_held = [], [], [], [], []
        cells = tuple(([], [], [], [], [], []) for _ in range(2))  # tag, node, text, key, mark, cells of a row

        for page in markup.cast(pa.binary()).to_pylist():
            tokens = raw_tokens("" if page is None else page.decode("utf-8", "replace"))
            shown, names = zip(*[known[token] for token in tokens])
            shape = shapes.get(names)
            if shape is None:
                shape = shape_of(names)
                if len(names) <= SHAPE_TAGS:
                    if len(shapes) >= SHAPES:
                        shapes.clear()
                    shapes[names] = shape
            found, numbers, rows, alike, sides = shape
            n_tokens.append(len(tokens))
            if "raw" in parts:
                raw += tokens
            if "text" in parts:
                texts += shown
            if "nodes" in parts:
                for column, values in zip(nodes, found):
                    column += values
                at += numbers
                n_nodes.append(len(numbers))
            if words or pick:
                page_text = " ".join([x for x in shown if x])
                if pick:
                    all_shown.append(page_text)
            if words:
                upper = page_text.upper()
                here = [w for w, capital, caseless in searched if (w in page_text if caseless else w in upper or not capital and w in page_text)]
                held += here
                n_held.append(len(here))
            if "tables" not in parts:
                continue
            n_tables.append(len(rows))
            n_rows += rows
            same += alike
            for (kinds, places, said, keys, marks, sizes), side in zip(cells, sides):
                sizes += side[3]
                if not side[1]:
                    continue
                kinds += side[0]
                places += side[1]
                if side[4] is not None:
                    own = [shown[first] for first in side[4]]
                else:
                    own = [shown[first] if stop - first == 1 else " ".join([x for x in shown[first:stop] if x]) for first, stop in side[2]]
                said += own
                told = [key_of[text] for text in own]
                keys += [x[0] for x in told]
                if groups:
                    marks += [x[1] for x in told]

        def nodes_made() -> pa.Array:
            tags, *places = nodes
            return lists(n_nodes, pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(tags, pa.string()), *[pa.array(p, pa.int32()) for p in places]], fields=list(NODE)))

        def tables_made() -> pa.Array:
            own_marks, paired_marks = (np.array(c[4], np.int32) for c in cells)
            own, paired = (
                lists(sizes, pa.StructArray.from_arrays(
                    [pa.array(k, pa.string()), pa.array(p, pa.int32()), pa.array(x, pa.string()), pa.array(n, pa.string()), *([pa.array(m)] if groups else [])], fields=list(cell_type)), gone)
                for (k, p, x, n, _, sizes), m, gone in zip(cells, (own_marks, paired_marks), (None, same))
            )
            rows, names = ([own, paired, *row_marks(own_marks, cells[0][5])], ["cells", "paired", "any", "all"]) if groups else ([own, paired], ["cells", "paired"])
            return lists(n_tables, lists(n_rows, pa.StructArray.from_arrays(rows, names)))

        made = {"shown": lambda: pa.array(all_shown, pa.string()), "raw": lambda: lists(n_tokens, pa.array(raw, pa.string())), "text": lambda: lists(n_tokens, pa.array(texts, pa.string())), "nodes": nodes_made, "tables": tables_made, "said": lambda: lists(n_held, pa.array(held, pa.string()))}
        return pa.StructArray.from_arrays([made[part]() for part in parts], list(parts))

    return run
