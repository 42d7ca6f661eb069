"""Facts of one detail page as columns over its element tree: pairs, columns, title, phone, validity.

A page is one row, so everything that belongs to it stays in arrays of that row:
document order is array order, and no shuffle is needed to put a page together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V
from . import html as H
from . import text as X
from . import tree as T

CUT = "\x01"  # stands for a label where a text is cut
PAIRS_TYPE = "array<struct<label:string,value:string>>"
COLUMNS_TYPE = "array<struct<name:string,descr:string,dtype:string,length:string>>"
COLUMN_PARTS = ("name", "descr", "dtype", "length")
PHONE_NORMS = X.norm_words(V.PHONE_LABELS)
# How a text starts whose normal form is a phone label; tells most texts apart without making it.
PHONE_START = rf"^{X.LABEL_NOISE}*[{''.join(sorted({n[0] for n in PHONE_NORMS}))}]"
SKIP_NORMS = X.norm_words(V.COLUMN_SKIP_WORDS)
LABEL_NORMS = list(dict.fromkeys(PHONE_NORMS + X.norm_words(V.BLOCK_LABELS)))


# --- tables --------------------------------------------------------------------------
def cells_of(t: Column, nodes: Column) -> Column:
    """array<struct<text>> of nodes."""
    return F.transform(nodes, lambda n: F.struct(T.text_of(t, n).alias("text")))


def table_rows(t: Column) -> Column:
    """Rows of every table, in page order; rows of an inner table belong to the outer one as well.

    ``cells`` are a row's own cells, or all below it where it has none itself; ``paired`` are
    all below it where it has just one, else null: the same. A cell's ``key`` is its text's ``norm_key``.
    """
    return t["tables"]


def column_header(rows: Column, searched: int | None = V.HEADER_SEARCH_ROWS) -> Column:
    """struct(row, name, descr, dtype, length) of 1-based positions, null for other tables.

    The header is looked for in the first ``searched`` rows, the portal's rule (None: in all).
    """
    def is_head(row: Column) -> Column:
        described = T.marked(row["any"], "descr", "length") & T.marked(row["any"], "extra")
        return T.marked(row["any"], "name") & (T.marked(row["any"], "dtype") | described)

    def at(cells: Column, name: str) -> Column:
        return F.array_position(F.transform(cells, lambda c: T.marked(c["mark"], name)), F.lit(True)).cast("int").alias(name)

    def look(i: Column) -> Column:
        return F.when(i.isNotNull(), X.let(F.get(rows, i)["cells"], lambda cells: F.struct((i + 1).alias("row"), *[at(cells, n) for n in COLUMN_PARTS])))

    heads = F.transform(rows if searched is None else F.slice(rows, 1, searched), lambda row, i: F.when(is_head(row), i))
    return X.let(F.get(F.filter(heads, lambda i: i.isNotNull()), F.lit(0)), look)


def tables_with_headers(t: Column) -> Column:
    return F.transform(table_rows(t), lambda r: F.struct(r.alias("rows"), column_header(r).alias("head")))


def _is_heading_row(row: Column) -> Column:
    """Empty rows, rows of labels only, the second header row, and repeated headers."""
    def joined() -> Column:
        return F.array_join(F.transform(row["cells"], lambda c: c["key"]), "")

    return (
        T.marked(row["all"], "skip")
        | (T.marked(row["any"], "again") & T.marked(row["any"], "again_with"))
        | (T.marked(row["any"], "run") & X.any_of(V.SUBHEADER_RUNS, joined()))
    )


def column_rows(tables: Column) -> Column:
    """Column descriptions of all column tables of a page, in page order."""
    blank = F.struct(F.lit("").alias("text"), F.lit("").alias("key"), F.lit(0).alias("mark"))

    def cell(cells: Column, at: Column) -> Column:
        return F.coalesce(X.let(F.get(cells, at - 1), lambda c: F.when(c.isNotNull(), F.struct(c["text"].alias("text"), c["key"].alias("key"), c["mark"].alias("mark")))), blank)

    def rows_of(t: Column) -> Column:
        body = F.slice(t["rows"], t["head"]["row"] + 1, F.greatest(F.size(t["rows"]) - t["head"]["row"], F.lit(0)))
        return F.transform(
            F.filter(body, lambda r: ~_is_heading_row(r)),
            lambda r: F.struct(*[cell(r["cells"], t["head"][k]).alias(k) for k in COLUMN_PARTS]),
        )

    def is_real(r: Column) -> Column:
        named = T.marked(r["name"]["mark"], "filled") & ~T.marked(r["name"]["mark"], "skip")
        filled = T.marked(reduce(lambda a, b: a.bitwiseOR(b), [r[k]["mark"] for k in COLUMN_PARTS[1:]]), "filled")
        run = reduce(lambda a, b: a.bitwiseOR(b), [r[k]["mark"] for k in COLUMN_PARTS])
        return named & filled & ~(T.marked(run, "run") & X.any_of(V.SUBHEADER_RUNS_LATE, F.concat(*[r[k]["key"] for k in COLUMN_PARTS])))

    described = F.filter(tables, lambda t: t["head"].isNotNull())
    real = F.filter(F.flatten(F.transform(described, rows_of)), is_real)
    return F.transform(real, lambda r: F.struct(*[r[k]["text"].alias(k) for k in COLUMN_PARTS]))


def column_list(columns: Column) -> Column:
    """Distinct column names in first-seen order (C14)."""
    names = F.transform(columns, lambda c: X.clean_text(c["name"]))
    return F.array_join(F.array_distinct(F.filter(names, lambda n: n != "")), ", ")


# --- label/value pairs --------------------------------------------------------------------
def phone_from_element(t: Column, node: Column, text: Column) -> Column:
    """Phone in an element's ``text``, else in the scripts below it, else in attributes below it."""
    inside = T.below(t, node)
    scripts = F.transform(T.tagged(inside, "script"), lambda n: T.text_of(t, n))
    # Most start tags have no attributes.
    told = F.filter(inside, lambda n: F.get(t["raw"], n["open"]).contains("="))
    values = F.flatten(F.transform(told, lambda n: H.attributes(T.start_tag(t, n), V.PHONE_ATTRIBUTES)))
    attributes = F.transform(values, lambda v: X.clean_text(v))
    sources = F.filter(F.concat(F.array(text), scripts, attributes), lambda s: s != "")

    def pick(s: Column) -> Column:
        phones = F.filter(F.transform(s, lambda x: X.phone_number(x)), lambda p: p != "")
        return F.when(X.is_portal_phone(F.array_join(s, " ")), "").otherwise(F.coalesce(F.get(phones, F.lit(0)), F.lit("")))

    return X.let(sources, pick)


def _pair(label: Column, value: Column) -> Column:
    return F.struct(label.alias("label"), value.alias("value"))


def _cell_value(t: Column, label: Column, cell: Column) -> Column:
    hidden = X.is_in(label["key"], PHONE_NORMS) & (X.phone_number(cell["text"]) == "")
    found = X.let(F.get(t["nodes"], cell["at"]), lambda n: phone_from_element(t, n, cell["text"]))
    return F.when(hidden, X.first_filled(found, cell["text"])).otherwise(cell["text"])


def _fits(label: Column) -> Column:
    return (label != "") & (F.length(label) <= V.MAX_LABEL_LENGTH)


def pairs_of_row(t: Column, cells: Column) -> Column:
    """``th`` followed by ``td`` (B7); without any such pair, cells two by two."""
    n = F.size(cells)

    def headed() -> Column:
        def pair(a: Column, b: Column) -> Column:
            return F.when(
                (a["tag"] == "th") & (b["tag"] == "td") & _fits(a["text"]), _pair(a["text"], _cell_value(t, a, b))
            )

        return F.filter(F.zip_with(F.slice(cells, F.lit(1), n - 1), F.slice(cells, F.lit(2), n - 1), pair), lambda p: p.isNotNull())

    def two_by_two() -> Column:
        starts = F.sequence(F.lit(0), n - 2, F.lit(2))
        both = F.transform(starts, lambda i: _pair(F.get(cells, i)["text"], F.get(cells, i + 1)["text"]))
        return F.filter(both, lambda p: _fits(p["label"]))

    return F.when(n < 2, F.array().cast(PAIRS_TYPE)).otherwise(
        X.let(headed(), lambda h: F.when(F.size(h) > 0, h).otherwise(two_by_two()))
    )


def table_pairs(t: Column, tables: Column) -> Column:
    plain = F.filter(tables, lambda x: x["head"].isNull())
    return F.flatten(F.flatten(F.transform(plain, lambda x: F.transform(x["rows"], lambda r: pairs_of_row(t, F.coalesce(r["paired"], r["cells"]))))))


def dl_pairs(t: Column) -> Column:
    """Terms and descriptions of each list, matched by position."""
    def of_list(dl: Column) -> Column:
        inside = T.below(t, dl)
        both = F.zip_with(
            cells_of(t, T.tagged(inside, "dt")), cells_of(t, T.tagged(inside, "dd")),
            lambda a, b: F.when(a.isNotNull() & b.isNotNull(), _pair(a["text"], b["text"])),
        )
        return F.filter(both, lambda p: p["label"] != "")

    return F.flatten(F.transform(T.tagged(t["nodes"], "dl"), of_list))


# --- text block --------------------------------------------------------------------------------
def text_block(text: Column, window: int | None = V.BLOCK_WINDOW) -> Column:
    """The stretch of page text that best looks like the metadata section.

    A stretch has ``window`` characters from its marker on, the portal's rule (None: to the end).
    """
    windows = "|".join(f"{m}.*" if window is None else f"{m}.{{0,{window - len(m)}}}" for m in V.BLOCK_MARKERS)
    starts = "".join(sorted({m[0] for m in V.BLOCK_MARKERS}))

    def scored(raw: Column, i: Column) -> Column:
        def score(block: Column) -> Column:
            labels = F.size(F.filter(X.word_array(V.BLOCK_LABELS), lambda x: F.contains(block, x)))
            named = block.contains(V.BLOCK_NAME_LABEL)
            opening = F.substring(raw, 1, 20).contains(V.BLOCK_NAME_LABEL)
            bonus = F.when(opening, 20).otherwise(0) + F.when(named, 5).when(block.contains(V.BLOCK_SERVICE_WORD), -5).otherwise(0)
            whole = reduce(lambda a, b: a & b, [block.contains(x) for x in V.BLOCK_REQUIRED])
            return F.struct(
                F.when(whole, labels + bonus).otherwise(-1).alias("score"), (-i).alias("earliest"), block.alias("block")
            )

        return X.let(F.substring_index(raw, V.BLOCK_END, 1), score)

    def best(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(rf"(?s)(?=[{starts}])(?=({windows}))"), F.lit(1))
        usable = F.filter(F.transform(found, scored), lambda s: s["score"] > -1)
        # A stretch has to hold all of these, so most texts without a block need no search.
        return F.when(reduce(lambda a, b: a & b, [t.contains(x) for x in V.BLOCK_REQUIRED]), F.array_max(usable)["block"])

    return F.coalesce(X.let(text, best), F.lit(""))


def block_pairs(block: Column) -> Column:
    """Labels in the block, each with the text up to the next label."""
    labels = X.one_of(V.BLOCK_LABELS, longest_first=True)
    names = F.regexp_extract_all(block, F.lit(f"({labels})"), F.lit(1))
    # Spark compiles the pattern of a split for every row but keeps that of a replacement.
    texts = F.when(block.contains(CUT), F.split(block, labels)).otherwise(F.split(F.regexp_replace(block, labels, CUT), CUT))

    def cut(v: Column) -> Column:
        return reduce(lambda t, stop: X.clean_text(F.substring_index(t, stop, 1)), V.BLOCK_STOP_PHRASES, v)

    def value(t: Column) -> Column:
        return X.let(X.clean_text(t), lambda v: F.when(X.any_of(V.BLOCK_STOP_PHRASES, v), cut(v)).otherwise(v))

    behind = F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0)))
    return F.zip_with(names, behind, lambda n, t: _pair(n, value(t)))


# --- title, counts, validity ---------------------------------------------------------------------
def page_title(t: Column) -> Column:
    """First title-like element that holds a real dataset title, else blank."""
    # One look at every node; the rules that follow read the few that are left. All title classes hold "tit".
    likely = F.filter(t["nodes"], lambda n: n["tag"].isin(*V.TITLE_TAGS) | F.get(t["raw"], n["open"]).contains("class"))

    def in_turn(held: Column) -> Column:
        classed = F.filter(held, lambda n: F.get(t["raw"], n["open"]).contains("class") & F.get(t["raw"], n["open"]).rlike("(?i)tit"))
        of_class = X.let(classed, lambda c: F.when(F.size(c) > 0, F.concat(*[T.matching(t, c, H.class_tag("[a-z][a-z0-9]*", name)) for name in V.TITLE_CLASSES])).otherwise(c))
        return F.concat(of_class, *[F.filter(held, lambda n: n["tag"] == tag) for tag in V.TITLE_TAGS])

    found = X.let(likely, in_turn)

    def keep(c: Column) -> Column:
        long_enough = c.contains("_") | (F.length(c) > 10)
        return (c != "") & ~c.isin(V.DETAIL_STOP_TITLES) & long_enough & ~X.is_menu_title(c)

    def title(n: Column) -> Column:
        return X.let(X.clean_dataset_title(T.text_of(t, n)), lambda c: F.when(keep(c), c))

    # Elements behind the one that decides are not read.
    return F.coalesce(F.aggregate(found, F.lit(None).cast("string"), lambda held, n: F.coalesce(held, title(n))), F.lit(""))


def detail_title(title: Column, fallback: Column) -> Column:
    return X.first_filled(title, X.clean_dataset_title(fallback))


def detail_download_count(text: Column) -> Column:
    hits = [F.regexp_extract(text, X.rx(p), 1) for p in V.DETAIL_DOWNLOAD_PATTERNS]
    return F.replace(X.first_filled(*hits), F.lit(","))


def invalid_reason(text: Column, block: Column, chars: int | None = V.INVALID_HEAD) -> Column:
    """Blank for a usable page, else why it is not one (B17), judged by the first ``chars`` (None: by all)."""
    def judged(head: Column) -> Column:
        searched = head.contains(V.LIST_PAGE_SEARCH)
        found = head.contains(V.LIST_PAGE_FOUND)
        listing = (head.contains(V.LIST_PAGE_QUESTION) & (searched | found)) | (
            head.contains(V.LIST_PAGE_NAME) & found & searched
        )
        said = X.first_said(V.UNAVAILABLE_PHRASES, head)
        return F.when(listing, "DATASET_LIST_PAGE").otherwise(F.coalesce(F.concat(F.lit("UNAVAILABLE_PAGE:"), said), F.lit("")))

    return F.when(text == "", "EMPTY_BODY").when(block != "", "").otherwise(
        X.let(text if chars is None else F.substring(text, 1, chars), judged)
    )


# --- department phone --------------------------------------------------------------------------------
def _phone_labels(t: Column, tags: tuple[str, ...] = ()) -> Column:
    """array<struct<node, text>> of the elements that say a phone label and no more."""
    # A label ends in this character, so only elements around a token that has it are spelled out.
    places = F.filter(F.transform(t["text"], lambda x, i: F.when(x.contains("호"), i)), lambda i: i.isNotNull())

    def around(held: Column) -> Column:
        near = F.filter(t["nodes"], lambda n: (n["tag"].isin(*tags) if tags else F.lit(True)) & F.exists(held, lambda i: (i >= n["open"]) & (i < n["stop"])))
        return F.transform(near, lambda n: F.struct(n.alias("node"), T.text_of(t, n).alias("text")))

    return F.filter(X.let(places, around), lambda x: x["text"].rlike(X.rx(PHONE_START)) & X.is_in(X.norm_key(x["text"]), PHONE_NORMS))


def _labelled_cell(t: Column) -> Column:
    """Value cell beside the first phone label in a table row or definition list (null if none)."""
    def beside(n: Column) -> Column:
        return F.get(T.tagged(T.siblings_behind(t, n), "td", "dd"), F.lit(0))

    return F.get(F.filter(F.transform(_phone_labels(t, ("th", "dt")), lambda x: beside(x["node"])), lambda n: n.isNotNull()), F.lit(0))


def _walk(t: Column, nodes: Column, label: Column | None) -> Column:
    """Reads elements in turn: ``found`` decides, ``parts`` is the text up to the next label or phone.

    With the text of a ``label``, elements that repeat it are passed over, and a phone in the
    text so far decides at once; else such a phone ends the walk.
    """
    def step(s: Column, n: Column) -> Column:
        def seen(text: Column) -> Column:
            def after(phone: Column) -> Column:
                parts = F.when(s["parts"] == "", text).otherwise(F.concat_ws(" ", s["parts"], text))

                def joined(p: Column) -> Column:
                    number = X.phone_number(p)
                    if label is None:
                        return F.struct((number != "").alias("done"), F.lit(None).cast("string").alias("found"), p.alias("parts"))
                    decided = F.when(X.is_portal_phone(p), "").otherwise(X.let(number, lambda v: F.when(v != "", v)))
                    return X.let(decided, lambda d: F.struct(d.isNotNull().alias("done"), d.alias("found"), p.alias("parts")))

                passed = text == "" if label is None else (text == "") | (text == label)
                return (
                    F.when(phone != "", F.struct(F.lit(True).alias("done"), phone.alias("found"), s["parts"].alias("parts")))
                    .when(passed, s)
                    .when(X.is_in(X.norm_key(text), LABEL_NORMS), F.struct(F.lit(True).alias("done"), s["found"].alias("found"), s["parts"].alias("parts")))
                    .otherwise(X.let(parts, joined))
                )

            return X.let(phone_from_element(t, n, text), after)

        return F.when(s["done"], s).otherwise(X.let(T.text_of(t, n), seen))

    return F.aggregate(nodes, F.struct(F.lit(False).alias("done"), F.lit(None).cast("string").alias("found"), F.lit("").alias("parts")), step)


def _free_label_value(t: Column, ahead: int) -> Column:
    """What follows the first stand-alone phone label that leads anywhere; null if none does.

    First the elements behind the label inside its parent, then the next ``ahead`` elements of the
    page, descendants included, up to another label.
    """
    def beside(n: Column) -> Column:
        def value(s: Column) -> Column:
            plain = F.when(X.is_portal_phone(s["parts"]), "").otherwise(X.first_filled(X.phone_number(s["parts"]), s["parts"]))
            return F.coalesce(s["found"], F.when(s["parts"] != "", plain))

        return X.let(_walk(t, T.siblings_behind(t, n), None), value)

    def behind(n: Column, text: Column) -> Column:
        return _walk(t, T.span(t["nodes"], n["at"] + 1, F.least(n["at"] + ahead, F.size(t["nodes"]) - 1)), text)["found"]

    start = F.lit(None).cast("string")
    return F.aggregate(_phone_labels(t), start, lambda held, x: F.coalesce(held, beside(x["node"]), behind(x["node"], x["text"])))


def department_phone(t: Column, block: Column, ahead: int = V.PHONE_LOOKAHEAD_TAGS, named: Column | None = None) -> Column:
    """Phone of the managing department (B15); a label with an empty cell ends the search.

    ``named`` tells whether the page's text has a phone label, where that is known.

    Behind a free-standing label the next ``ahead`` elements are read, the portal's rule.
    """
    def of_cell(n: Column) -> Column:
        def value(text: Column) -> Column:
            plain = F.when(X.is_portal_phone(text), "").otherwise(text)
            return X.first_filled(phone_from_element(t, n, text), X.phone_number(text), plain)

        return X.let(T.text_of(t, n), value)

    def in_block(b: Column) -> Column:
        return X.let(X.phone_after_label(b), lambda v: F.when(X.is_portal_phone(v), "").otherwise(v))

    loose = F.coalesce(_free_label_value(t, ahead), in_block(block))
    named = (T.page_text(t).rlike(X.rx(V.PHONE_LABEL_PATTERN)) if named is None else named) | block.rlike(X.rx(V.PHONE_LABEL_PATTERN))
    found = X.let(_labelled_cell(t), lambda n: F.when(n.isNotNull(), of_cell(n)).otherwise(loose))
    return F.when(named, found).otherwise("")
