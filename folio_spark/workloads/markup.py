"""Catalogue pages built by Spark from the base tables, for queries whose SQL reads the tables.

The pages grow with the tables. Groups collected here are one page each: the cards of one
page number, or the columns of one dataset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from .registry import PORTAL, stored, table

CARDS_PER_PAGE_KEYS = 100


def cat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def listed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand pages of parts; large parts show up again on the next page."""
    part = table(spark, sf_dir, "part")
    page = F.floor(F.col("p_partkey") / CARDS_PER_PAGE_KEYS).cast("int")
    shown = F.when(F.col("p_size") > 40, F.array(page + 1, page + 2)).otherwise(F.array(page + 1))
    return part.select(F.col("p_brand").alias("org"), F.explode(shown).alias("page_no"), "p_partkey", "p_name", "p_type", "p_size")


def card(key: Column, name: Column, provider: Column, category: Column, size: Column) -> Column:
    return cat(
        '<li class="item"><a class="go" href="/data/', key.cast("string"), '/fileData.do"><span class="title">CSV ', name, "_",
        key.cast("string"), ' Update</span></a><p>제공기관 ', provider, " 분류체계 ", category, " 수정일 2024.3.", size.cast("string"),
        "<span>조회수 ", thousands(key * 7), "</span> <span>다운로드 ", size.cast("string"), "</span></p></li>",
    )


def listing_page(cards: Column, total: Column) -> Column:
    return cat(
        '<html><head><title>목록</title><style>li{margin:0}</style></head><body><!-- <li>old</li> -->'
        '<div class="wide result-list"><div class="sort">정렬</div><ul>', F.array_join(cards, "\n"), "</ul></div><p>총 ",
        thousands(total), ' 건이 검색되었습니다</p><div class="foot"><ul><li><a href="/data/999999999/fileData.do">최근 데이터</a></li></ul></div></body></html>',
    )


def brand_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ten to a page in each brand; large parts show up again on the next page.

    Brands that end in 3 lack the page after their middle, where the walk stops.
    """
    part = number_rows(table(spark, sf_dir, "part"), ["p_partkey"], "_n", within=["p_brand"])
    total = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("_brand")).agg(F.count("*").alias("_total"))
    page = F.floor((F.col("_n") - 1) / 10).cast("int")
    shown = F.when(F.col("p_size") > 40, F.array(page + 1, page + 2)).otherwise(F.array(page + 1))
    held = part.join(total, F.col("p_brand") == F.col("_brand")).withColumn("page_no", F.explode(shown))
    held = held.where(~F.col("p_brand").endswith("3") | (F.col("page_no") != F.floor(F.col("_total") / 20) + 2))
    return held.select(F.col("p_brand").alias("org"), "page_no", "p_partkey", "p_name", "p_type", "p_size")


def part_listing(spark: SparkSession, sf_dir: str, parts: DataFrame | None = None) -> DataFrame:
    rows = (listed_parts(spark, sf_dir) if parts is None else parts).select(
        "org", "page_no",
        F.struct("p_partkey", card(F.col("p_partkey"), F.col("p_name"), F.col("org"), F.col("p_type"), F.col("p_size")).alias("li")).alias("c"),
    )
    pages = rows.groupBy("org", "page_no").agg(F.array_sort(F.collect_list("c")).alias("cs"), F.count("*").alias("n"))
    return stored(pages, "page_no").select(
        "org",
        "page_no",
        F.concat(F.lit(PORTAL + "/list?org="), F.url_encode("org"), F.lit("&currentPage="), F.col("page_no").cast("string")).alias("list_url"),
        F.lit(200).alias("status"),
        listing_page(F.transform("cs", lambda c: c["li"]), F.col("n")).alias("html"),
    )


def row(*cells: tuple[str, str | Column]) -> Column:
    parts: list[str | Column] = ["<tr>"]
    for tag, text in cells:
        parts += [f"<{tag}>", text, f"</{tag}>"]
    return cat(*parts, "</tr>")


def dotted_date(c: Column) -> Column:
    return F.concat_ws(".", F.year(c), F.month(c), F.day(c))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    return stored(orders.join(customer, orders.o_custkey == customer.c_custkey), "o_orderkey").select(
        "o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority",
        F.floor("o_totalprice").cast("long").alias("total"), "c_name", "c_mktsegment", "c_custkey",
    )


def th_td_table() -> Column:
    return cat(
        "<table>",
        row(("th", "제공기관"), ("td", F.col("c_mktsegment"))),
        row(("th", "관리부서명"), ("td", F.col("c_name")), ("th", "등록일"), ("td", dotted_date(F.col("o_orderdate")))),
        row(("td", "키워드"), ("td", F.col("o_orderpriority")), ("td", "매체유형"), ("td", cat("<b>", F.col("o_orderstatus"), "</b>&amp;"))),
        row(("th", "빈칸")),
        "</table>",
    )


def dl_list() -> Column:
    return cat("<dl><dt>전체 행<dd>", thousands(F.col("total")), " 건<dt>업데이트 주기</dt><dd>", F.col("o_orderpriority"), "</dd><dt>남음</dt></dl>")


def block_text() -> Column:
    return cat(
        "<div>파일데이터 정보 서비스 안내</div><p>파일데이터명 ", F.col("c_name"), "_", F.col("o_orderkey").cast("string"),
        " 분류체계 ", F.col("c_mktsegment"), " - ", F.col("o_orderstatus"), " 제공기관 ", F.col("c_name"),
        " 관리부서 전화번호 02-", F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), "-0001 보유근거 수집방법 ",
        F.col("o_orderpriority"), " 활용신청 버튼</p><p>오픈API 정보 관리기관 1566-0025 키워드 밖</p>",
    )


COLUMN_HEAD = (
    "<tr><th rowspan=2>항목명</th><th>항목 설명</th><th>데이터타입</th><th>최대길이</th></tr>"
    "<tr><th>정보시스템명</th><th>DB명</th><th>Table명</th></tr>"
)


def order_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, tables): the column table of each order that has lines."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.struct(
            "l_linenumber", "l_partkey", "l_suppkey",
            row(
                ("td", cat("p", F.col("l_partkey").cast("string"))),
                ("td", F.date_format("l_shipdate", "yyyy-MM-dd")),
                ("td", F.col("l_returnflag")),
                ("td", F.col("l_quantity").cast("int").cast("string")),
            ).alias("tr"),
        ).alias("c"),
    )
    rows = F.transform(F.array_sort(F.collect_list("c")), lambda c: c["tr"])
    grouped = li.groupBy("l_orderkey").agg(cat("<table>", COLUMN_HEAD, F.array_join(rows, ""), "</table>").alias("columns_html"))
    return stored(grouped, "l_orderkey")


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detail page per order: pair tables, list, text block and column table.

    Orders of status P answer with an error screen instead.
    """
    facts = order_facts(spark, sf_dir)
    cols = order_columns(spark, sf_dir)
    body = cat("<h1>", F.col("c_name"), "_", F.col("o_orderkey").cast("string"), "_", F.date_format("o_orderdate", "yyyyMMdd"), "</h1>",
               th_td_table(), dl_list(), block_text(), F.coalesce("columns_html", F.lit("")))
    failed = cat("<h1>안내</h1><p>잘못된 접근입니다</p>")
    filler = F.lit("<footer>" + "고객지원 " * 120 + "</footer>")
    joined = facts.join(cols, facts.o_orderkey == cols.l_orderkey, "left")
    return stored(joined, "o_orderkey").select(
        "o_orderkey",
        order_url(F.col("o_orderkey")).alias("url"),
        F.lit(200).alias("status"),
        cat("<html><body>", F.when(F.col("o_orderstatus") == "P", failed).otherwise(body), filler, "</body></html>").alias("html"),
    )


def order_url(key: Column) -> Column:
    return cat(PORTAL + "/data/", key.cast("string"), "/fileData.do")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as a listing would give them, one per order."""
    facts = order_facts(spark, sf_dir)
    name = cat(F.col("c_name"), "_", F.col("o_orderkey").cast("string"))
    null = F.lit(None).cast("string")
    return facts.select(
        (F.col("o_orderkey") + 1).alias("seq"),
        name.alias("raw_title"),
        name.alias("title"),
        F.lit("anchor").alias("title_source"),
        F.lit("CSV").alias("formats"),
        (F.col("o_orderkey") * 7).cast("string").alias("views"),
        F.col("c_custkey").cast("string").alias("downloads"),
        order_url(F.col("o_orderkey")).alias("detail_url"),
        F.lit("").alias("source_list_url"),
        null.alias("provider"),
        F.lit("목록분류").alias("category"),
        null.alias("registered"),
        F.lit("2024.1.5").alias("modified"),
    )
