"""What the page readers read, against the ``Column`` rules of the same pages."""

import random
from functools import reduce

import pytest
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio_spark import vocab as V
from folio_spark.functions import detail_html as D
from folio_spark.functions import html as H
from folio_spark.functions import text as X
from folio_spark.functions import tree as T
from folio_spark.functions import urls as U
from folio_spark.operators import detail as DT
from folio_spark.operators import fields as P
from folio_spark.operators import listing as L


def column_pages(pages, check_blocks):
    """``parse_pages`` made of the ``Column`` rules."""
    usable = F.col("error").isNull()
    telling = (F.col("text") == "") | T.says(F.col("tree"), V.UNAVAILABLE_PHRASES + V.LIST_PAGE_WORDS)
    phoned = F.when(T.says(F.col("tree"), [V.PHONE_LABEL_END]), F.col("text").rlike(X.rx(V.PHONE_LABEL_PATTERN))).otherwise(False)
    formats = F.when(T.says(F.col("tree"), V.FORMATS), F.array_join(X.detect_formats(F.col("text")), " ")).otherwise("")
    pairs = F.concat(D.table_pairs(F.col("tree"), F.col("tables")), D.dl_pairs(F.col("tree")), D.block_pairs(F.col("block")))
    steps = [
        [
            "url", "error", "text", "block",
            F.when(usable, F.col("tree")).otherwise(T.blank()).alias("tree"),
            F.when(usable & telling, D.invalid_reason(F.col("text"), F.col("block"))).otherwise("").alias("invalid_reason"),
        ],
        ["*", D.tables_with_headers(F.col("tree")).alias("tables")],
        [
            "url", "error", "tree", "text", "block", "invalid_reason", D.page_title(F.col("tree")).alias("page_title"),
            P.mapped(pairs).alias("fields"), D.column_rows(F.col("tables")).alias("columns"),
        ],
        ["*", P.fold_phone(F.col("fields")).alias("phone"), P.last_value(F.col("fields"), "formats").alias("format_value")],
        [
            "url", "error", "invalid_reason", "page_title", P.fold_fields(F.col("fields"), DT.FOLDED).alias("values"),
            P.first_value(F.col("fields"), "dataset_name").alias("name_value"), "format_value", "columns",
            F.when(X.phone_number(F.col("phone")) != "", F.col("phone"))
            .otherwise(X.first_filled(D.department_phone(F.col("tree"), F.col("block"), named=phoned), F.col("phone")))
            .alias("dept_phone"),
            # Only pages without a format field of their own fall back to the whole text.
            F.when(F.col("format_value").isNull(), formats).otherwise("").alias("page_formats"),
        ],
    ]
    return reduce(lambda df, columns: df.select(*columns), steps, DT.page_texts(pages, check_blocks))


def _unique_links(items: Column) -> Column:
    """First item per link address of one page."""
    return X.let(
        F.struct(items.alias("i"), F.transform(items, lambda i: i["url"]).alias("u")),
        lambda p: F.filter(p["i"], lambda i, n: F.array_position(p["u"], i["url"]) == n + 1),
    )


def _resolved(t: Column, nodes: Column, base: Column) -> Column:
    """Links among ``nodes`` that lead to a data page, with their full addresses."""
    full = F.transform(L._data_links(t, nodes), lambda a: F.struct(a["node"].alias("node"), U.absolute_url(base, a["href"]).alias("url")))
    return F.filter(full, lambda a: U.is_detail_url(a["url"]))


def _page_items(t: Column, base: Column) -> Column:
    """Cards of a page; a page without any card gives all its data links instead."""
    def linked(li: Column) -> Column:
        return X.let(F.get(_resolved(t, T.below(t, li), base), F.lit(0)), lambda a: F.struct(li.alias("li"), a["url"].alias("url"), a["node"].alias("link")))

    cards = F.filter(F.transform(L._list_items(t, L.RESULT_LIST), linked), lambda i: i["url"].isNotNull())
    loose = F.transform(
        _resolved(t, t["nodes"], base),
        lambda a: F.struct(F.when(F.lit(False), a["node"]).alias("li"), a["url"].alias("url"), a["node"].alias("link")),
    )
    return X.let(cards, lambda c: F.when(F.size(c) > 0, c).otherwise(loose))


def column_cards(pages: DataFrame) -> DataFrame:
    t = F.col("tree")

    def read(i: Column) -> Column:
        return F.struct(
            i["url"].alias("url"), i["li"].isNotNull().alias("is_card"), L._text_or_blank(t, i["li"]).alias("text"),
            T.text_of(t, i["link"]).alias("anchor_text"),
            F.when(i["li"].isNull(), "").otherwise(L._text_or_blank(t, L._title_node(t, i["li"]))).alias("title_text"),
        )

    found = L._trees(pages).select(*L.CARD_KEYS, "tree", _unique_links(_page_items(t, F.col("list_url"))).alias("found"))
    items = found.select(*L.CARD_KEYS, F.posexplode(F.transform("found", read)).alias("pos", "item"))
    parts = items.select(
        *L.CARD_KEYS, "pos", F.col("item.url").alias("detail_url"), "item.is_card", "item.text", "item.anchor_text", "item.title_text"
    )

    def usable(c: Column) -> Column:
        return X.let(X.clean_dataset_title(c), lambda t: F.when(X.is_menu_title(t), "").otherwise(t))

    titled = parts.select(
        "*",
        F.when(F.col("is_card"), usable(F.col("anchor_text"))).otherwise("").alias("t_anchor"),
        F.when(F.col("is_card"), usable(F.col("title_text"))).otherwise("").alias("t_title"),
        F.when(F.col("is_card"), X.card_counts(F.col("text"))).alias("counts"),
    )
    named = titled.select(
        "*",
        X.first_filled(F.col("t_anchor"), F.col("t_title"), F.col("anchor_text")).alias("raw_title"),
        F.when(~F.col("is_card"), "fallback_anchor")
        .when(F.col("t_anchor") != "", "anchor")
        .when(F.col("t_title") != "", "title_selector")
        .otherwise("anchor_raw")
        .alias("title_source"),
    )
    return named.select(
        "org",
        "page_no",
        "pos",
        "raw_title",
        X.clean_dataset_title(F.col("raw_title")).alias("title"),
        "title_source",
        F.array_join(X.detect_formats(X.first_filled(F.col("raw_title"), F.col("text"))), " ").alias("formats"),
        F.coalesce("counts.views", F.lit("")).alias("views"),
        F.coalesce("counts.downloads", F.lit("")).alias("downloads"),
        "detail_url",
        F.col("list_url").alias("source_list_url"),
        *[X.filled(X.labelled_value(F.col("text"), label)).alias(k) for k, label in V.CARD_TARGETS.items()],
    )


WORDS = [
    *V.BLOCK_LABELS, *V.COLUMN_SKIP_WORDS, *V.HEADER_NAME_KEYS, *V.HEADER_TYPE_KEYS, *V.PHONE_LABELS, *V.BLOCK_MARKERS, *V.BLOCK_REQUIRED, *V.BLOCK_STOP_PHRASES,
    *[s for names in V.LABEL_SPELLINGS.values() for s in names], *V.POLLUTED_VALUES, *V.FORMATS, *V.MENU_WORDS, *V.MENU_PHRASES, *V.UNAVAILABLE_PHRASES,
    "hwpx", "xls,", "CSV²", "csv파일", "New", "Updated", "(교통 현황)", "교통_현황_20240101", "현황 | 공공데이터포털", "02-123-4567", "031)222-3333", "관리기관 1566-0025",
    "+82-2-123-4567", "٠١٢", "&amp;", "&#44032;", "&lt;b&gt;", "1 < 2", "아주 긴 데이터셋 이름입니다", "x" * 81, "", "　", "조건검색", "건이 검색되었습니다", "데이터목록", "İ", "ſ", "K",
]
RARE = [*V.BLOCK_PHRASES, "HTTP 429", "error 403", "403 Forbidden", "xHTTP429", "Error 429é"]
TAGS = "div div ul li table tr td th dl dt dd p span b a br h1 h2 title em section".split()
ATTRIBUTES = [
    "", "", "", ' class="title"', " class='a tit b'", ' CLASS="view-title"', ' class="subtitle"', " data-tel='02-999-8888'", ' value="031 222 3333" title="x"',
    " aria-label=051-444-5555", "\ndata-phone\n=\n'02)111-2222'", ' title="a&amp;b 02-777-6666"',
]
CARD_WORDS = [
    *V.CARD_VALUE_LABELS, *V.FORMATS, *V.MENU_WORDS, "New", "Update", "교통_현황", "주차 현황_20240101", "1,234", "(건)", ":", "조회수 5 다운로드 6", "조회 수 : 7 다운로드 수: 8",
    "서울특별시", "2024.3.1", "x" * 201, "<b>b</b>", "&amp;", "파일CSV", "[제목]",
]
LINKS = [
    "/data/1/fileData.do", "/data/2/fileData.do#a b", "../dataset/3", "./data/4/x/../fileData.do", "/data/../data/5", "data/6?x=1#f", "//h.example/data/7", "http://o.example/dataset/8",
    "?q=/data/9", "#/data/10", "/dataset/x?dataId=11", "  /data/12  ", "/about", "a/./b/data/13/.", "a/data/14/..", "/data/&#49;6", "/data/17\n", "/data/18#a\nb", "x:/data/19", "/data/٣",
]
BASES = ["https://portal.example/a/b/list?p=1", "https://portal.example", "https://portal.example/x//y/list#f", "", None, "nonsense"]


def detail_page(rng):
    def text():
        return rng.choice(RARE) if rng.random() < 0.01 else rng.choice(WORDS)

    def soup():
        made = [f"<{'/' if rng.random() < 0.3 else ''}{rng.choice(TAGS)}{rng.choice(ATTRIBUTES)}>{text()} {text()}" for _ in range(rng.randrange(30))]
        return "".join(made) + rng.choice(["", "<script>$('#t').text('02-1234-5678')</script>", "<!-- <td>x -->"])

    def columns():
        rows = [rng.sample([*V.HEADER_NAME_KEYS, "항목 설명", "데이터타입", "최대길이", "비고"], 4)] + [[text() for _ in range(rng.randrange(6))] for _ in range(4)]
        rows.insert(1, rng.choice([["정보시스템명", "DB명", "Table명"], ["정보시스템명 DB명", "테이블명"], ["a", "b"]]))
        return "<table>" + "".join("<tr>" + "".join(f"<{rng.choice(['td', 'th'])}>{x}" for x in row) for row in rows) + "</table>"

    def phone():
        label = rng.choice(V.PHONE_LABELS)
        return rng.choice([
            f"<div><b>{label}</b><i{rng.choice(ATTRIBUTES)}>{text()}</i><i>{text()}</i></div>", f"<table><tr><th>{label}<td><span{rng.choice(ATTRIBUTES)}>{text()}</table>",
            f"<dl><dt>{label}<dd>{text()}</dl>", f"<p>{label}: {text()} 보유근거</p>", f"<section>x<p><b>{label}</b></p></section>" + f"<u{rng.choice(ATTRIBUTES)}>{text()}</u>" * 9,
        ])

    def block():
        return f"<p>{rng.choice(V.BLOCK_MARKERS)} " + " ".join(rng.choice([text(), rng.choice(V.BLOCK_LABELS)]) for _ in range(12)) + rng.choice([" 분류체계 x 제공기관 y", "", " 오픈API 정보 "])

    parts = [rng.choice([soup, columns, phone, block, lambda: f"<h1>{text()} {text()}_현황</h1>"])() for _ in range(rng.randrange(5))]
    return "".join(parts) + ("<footer>" + "고객지원 " * 120 + "</footer>" if rng.random() < 0.9 else "")


def listing_page(rng):
    def text():
        return " ".join(rng.choice(CARD_WORDS) for _ in range(rng.randrange(5)))

    def link():
        return f"<a{rng.choice(ATTRIBUTES)} {rng.choice(['href=', 'HREF = '])}\"{rng.choice(LINKS)}\">{text()}</a>"

    def item():
        made = [link, link, lambda: f"<span{rng.choice(ATTRIBUTES)}>{text()}</span>", text, lambda: f"<ul><li>{text()}{link()}</ul>"]
        return f"<li{rng.choice(ATTRIBUTES)}>" + "".join(rng.choice(made)() for _ in range(rng.randrange(6)))

    def box():
        return f"<div class='{rng.choice(['result-list', 'wide result-list', 'results'])}'><ul>" + "".join(item() for _ in range(4)) + rng.choice(["</ul>", "</div>"]) + "</div>"

    return "".join(rng.choice([box, box, link, item, text])() for _ in range(rng.randrange(4)))


@pytest.mark.parametrize("check_blocks", [True, False])
def test_pages_read_as_the_column_rules_do(spark, check_blocks):
    rng = random.Random(3)
    rows = [(f"u{i}", rng.choice([200, 200, 200, 404, 403, None]), detail_page(rng) if i % 97 else None) for i in range(500)]
    pages = spark.createDataFrame(rows, "url string, status int, html string")

    def usable(parsed):  # of other pages only the error is read
        return {r["url"]: r if r["error"] is None else r["error"] for r in parsed.collect()}

    got, want = usable(DT.parse_pages(pages, check_blocks)), usable(column_pages(pages, check_blocks))
    assert len(got) == 500 and sum(isinstance(r, str) for r in got.values()) < 350
    for url in want:
        assert got[url] == want[url], url


def test_cards_read_as_the_column_rules_do(spark):
    rng = random.Random(4)
    rows = [("o", i, rng.choice(BASES), listing_page(rng) if i % 97 else None) for i in range(500)]
    pages = spark.createDataFrame(rows, "org string, page_no int, list_url string, html string")
    got, want = ({(r["page_no"], r["pos"]): r for r in made.collect()} for made in (L.cards(pages), column_cards(pages)))
    assert len(got) > 300 and got == want


def test_trees_stay_in_the_tasks_that_read_them(spark):
    """Only what a page says leaves its task, and a page is read once."""
    pages = spark.createDataFrame([("u", 200, "<p>x</p>")], "url string, status int, html string")
    lists = spark.createDataFrame([("o", 1, "l", "<p>x</p>")], "org string, page_no int, list_url string, html string")
    for made in (DT.parse_pages(pages), L.cards(lists)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "nodes" not in plan
