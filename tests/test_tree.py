"""The element tree against a literal parser, and the page rules on nested markup."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folio_spark.functions import detail_html as D
from folio_spark.functions import html as H
from folio_spark.functions import tree as T
from folio_spark.operators import listing as L

PORTAL = "https://portal.example"
GROUP = {"td": "cell", "th": "cell", "dt": "term", "dd": "term", "thead": "section", "tbody": "section", "tfoot": "section"}


def literal(markup):
    """(tag, open, stop, last, parent) of every element, by a stack of objects."""
    tokens = [x for x in re.split(r"(?=<[a-zA-Z/!?])", markup) if x]
    inline = set(T.INLINE.split("|"))
    nodes, stack = [], []

    def close(group, bar, at):
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][1] == group:
                above = {g for _, g in stack[depth + 1 :]}
                if {"free": False, "inline": above - inline, "table": "table" in above, "row": above & {"table", "tr"}, "cell": above & {"table", "cell"}}[bar]:
                    return
                for k, _ in stack[depth:]:
                    nodes[k][2:4] = [at, len(nodes) - 1]
                del stack[depth:]
                return

    for at, token in enumerate(tokens):
        m = re.match(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)", token)
        if not m:
            continue
        tag = m[2].lower()
        group = GROUP.get(tag, tag)
        if m[1]:
            bar = "table" if group in ("tr", "section", "cell") else "free" if group == "table" else "inline" if group in inline else "cell"
            close(group, bar, at)
            continue
        if group in ("li", "cell", "tr", "term", "section", "option", "a"):
            close(group, {"cell": "row", "tr": "table", "section": "table"}.get(group, "inline"), at)
        elif tag in T.BLOCKS:
            close("p", "inline", at)
        parent = stack[-1][0] if stack else -1
        nodes.append([tag, at, at, len(nodes), parent])
        if tag not in T.VOID:
            stack.append((len(nodes) - 1, group))
    for k, _ in stack:
        nodes[k][2:4] = [len(tokens), len(nodes) - 1]
    return [tuple(n) for n in nodes]


def trees(spark, pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, h string").select("i", T.tree(F.col("h")).alias("t")).orderBy("i").collect()
    return [r["t"] for r in rows]


def test_random_markup(spark):
    rng = random.Random(5)
    tags = ["div", "ul", "li", "table", "tr", "td", "th", "tbody", "dl", "dt", "dd", "p", "span", "b", "a", "br", "option", "h1", "LI"]
    pages = []
    for _ in range(250):
        parts = []
        for _ in range(rng.randrange(0, 60)):
            parts.append(rng.choice(["<{}>", "<{}>", "</{}>", "<{} class=x>"]).format(rng.choice(tags)))
            parts.append(rng.choice(["", "t", " 1 < 2 ", "&amp;"]))
        pages.append("".join(parts))
    for page, tree in zip(pages, trees(spark, pages)):
        assert [(n["tag"], n["open"], n["stop"], n["last"], n["parent"]) for n in tree["nodes"]] == literal(page), page
        assert [n["at"] for n in tree["nodes"]] == list(range(len(tree["nodes"])))


def test_many_tokens_pass_chunk_ends(spark):
    page = "<ul>" + "<li><b>x</b><ul><li>y</ul>" * 700 + "</ul><p>end"
    (tree,) = trees(spark, [page])
    assert [(n["tag"], n["open"], n["stop"], n["last"], n["parent"]) for n in tree["nodes"]] == literal(page)


def test_empty_and_plain(spark):
    for tree in trees(spark, [None, "", "only text", "<!doctype html>", "</div></p>"]):
        assert tree["nodes"] == []


def test_page_text_is_the_shown_text(spark):
    pages = ["<p>a<b>b</b> <script>var d='x';</script>&lt;f&gt; &amp;lt; &nbsp;g 1 < 2</p>", "x<br>y <i> </i>", None]
    rows = spark.createDataFrame([(p,) for p in pages], "h string").select(H.visible(F.col("h")).alias("m"))
    assert all(r["a"] == r["b"] for r in rows.select(T.page_text(T.read(F.col("m"))).alias("a"), H.text_of(F.col("m")).alias("b")).collect())


def in_tree(spark, html, rule):
    rows = spark.createDataFrame([(html,)], "h string").select(T.tree(H.visible(F.col("h"))).alias("t"))
    return rows.select(rule(F.col("t")).alias("x")).first()["x"]


def test_table_inside_a_cell(spark):
    html = "<table><tr><th>A</th><td>x<table><tr><th>in</th><td>1</td></tr></table>y</td></tr><tr><th>B</th><td>z</td></tr></table>"
    got = in_tree(spark, html, lambda t: D.table_pairs(t, D.tables_with_headers(t)))
    # Rows of the inner table count for both tables.
    assert [tuple(p) for p in got] == [("A", "x in 1 y"), ("in", "1"), ("B", "z"), ("in", "1")]


def test_column_table_with_a_table_in_a_cell(spark):
    html = (
        "<table><tr><th>항목명</th><th>항목 설명</th><th>데이터타입</th></tr>"
        "<tr><td>a</td><td>d <table><tr><td>note</td></tr></table></td><td>int</td></tr><tr><td>b</td><td></td><td>text</td></tr></table>"
    )
    got = in_tree(spark, html, lambda t: D.column_rows(D.tables_with_headers(t)))
    assert [tuple(r) for r in got] == [("a", "d note", "int", ""), ("b", "", "text", "")]


def test_title_with_inner_blocks(spark):
    html = '<div class="title"><div>교통_</div><div>현황 <b>2024</b></div></div>'
    assert in_tree(spark, html, D.page_title) == "교통_ 현황 2024"


def phone(spark, html):
    return in_tree(spark, html, lambda t: D.department_phone(t, F.lit("")))


LABEL = "관리부서 전화번호"


@pytest.mark.parametrize(
    "html,want",
    [
        (f"<div><div><b>{LABEL}</b></div><div><p><i>02-111-2222</i></p></div></div>", "02-111-2222"),  # next tags, other subtree
        (f"<div><b>{LABEL}</b><div><span>담당 <em>031-222-3333</em></span></div></div>", "031-222-3333"),  # sibling with descendants
        (f"<div><b>{LABEL}</b><i>a</i><i>b</i><i>c</i><b>보유근거</b><i>02-1-1</i></div>", "a b c"),  # siblings up to a label
        (f"<div>x<p><b>{LABEL}</b></p></div><u>1</u><u>2</u><u>3</u><u>4</u><u>5</u><u>6</u><u>7</u><u>8</u><u>02-111-2222</u>", ""),  # beyond eight
        (f"<section>x<p><b>{LABEL}</b></p><p></p></section><p>a b c d e f</p>", ""),  # no phone in the next tags
        (f"<div><b>{LABEL}</b><span></span><script>$('#t').text('042-333-4444')</script></div>", "042-333-4444"),  # script as sibling
        (f"<div><b>{LABEL}</b><span><i data-tel='051-444-5555'></i></span></div>", "051-444-5555"),  # attribute below a sibling
        (f"<table><tr><th>{LABEL}</th><td><table><tr><td>in</td><td>02-555-6666</td></tr></table></td></tr></table>", "02-555-6666"),
    ],
)
def test_phone_in_other_subtrees(spark, html, want):
    assert phone(spark, html) == want


def test_cards_with_lists_inside(spark):
    card = (
        '<div class="result-list"><div class="result-list"><ul><li><a href="/data/1/fileData.do">교통_현황</a><ul class="tags"><li>a</li><li>b</ul>'
        "<p>제공기관 서울 조회수 12 다운로드 3</p></li><li><div><a href='/data/2/fileData.do'>주차_현황</a></div><span>조회수 5 다운로드 6</span></ul></div></div>"
    )
    pages = spark.createDataFrame([("o", 1, PORTAL + "/l", card)], "org string, page_no int, list_url string, html string")
    rows = [(r.title, r.views, r.downloads, r.provider) for r in L.cards(pages).orderBy("pos").collect()]
    assert rows == [("교통_현황", "12", "3", "서울"), ("주차_현황", "5", "6", None)]
    assert [(r.title, r.views, r.downloads) for r in L.counts_cards(pages, PORTAL).orderBy("pos").collect()] == [("교통_현황", 12, 3), ("주차_현황", 5, 6)]
    assert [r.title for r in L.download_cards(pages, PORTAL).orderBy("pos").collect()] == ["교통_현황", "주차_현황"]


def test_phone_in_spread_attributes(spark):
    """A start tag may break its lines and space its equals sign; tags without attributes are passed over."""
    assert phone(spark, f"<div><b>{LABEL}</b><i><u></u><em\ndata-tel\n=\n'02-111-2222'></em></i></div>") == "02-111-2222"
