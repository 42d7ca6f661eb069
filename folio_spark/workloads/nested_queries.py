"""The listing and detail rules on markup that nests: lists in cards, tables in cells, blocks in titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import detail_html as DH
from ..functions import html as H
from ..functions import tree as T
from ..operators import listing as L
from . import markup as M
from .registry import PORTAL, query, stored, table


def nested_listing(spark, sf_dir):
    """One page per brand and part number range; each card holds a list of its own, every other one is left open."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    card = M.cat(
        '<li><div><a href="/data/', key, '/fileData.do">자료_', key, "</a></div><ul class='tags'><li>", F.col("p_name"), "<li><b>x</b></ul><p>제공기관 ",
        F.col("p_brand"), " 분류체계 ", F.col("p_type"), " 수정일 2024.3.", size, "<span>조회수 ", M.thousands(F.col("p_partkey") * 7),
        "</span> <span>다운로드 ", size, "</span></p>", F.when(F.col("p_partkey") % 2 == 0, "</li>").otherwise(""),
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("org"), F.floor(F.col("p_partkey") / 500).cast("int").alias("page_no"), F.struct("p_partkey", card.alias("li")).alias("c"))
    pages = stored(parts.groupBy("org", "page_no").agg(F.array_sort(F.collect_list("c")).alias("cs")), "org")
    body = F.array_join(F.transform("cs", lambda c: c["li"]), "")
    return pages.select("org", "page_no", F.lit(PORTAL + "/list").alias("list_url"), M.cat('<div class="result-list"><div class="result-list"><ul>', body, "</ul></div></div>").alias("html"))


@query("b1_nested_cards", f"""
SELECT p_partkey, '자료_' || p_partkey AS title, CAST(p_partkey * 7 AS VARCHAR) AS views, CAST(p_size AS VARCHAR) AS downloads,
  '{PORTAL}/data/' || p_partkey || '/fileData.do' AS detail_url, p_brand AS provider, p_type AS category, '2024.3.' || p_size AS modified FROM part""")
def b1_nested_cards(spark, sf_dir):
    number = F.regexp_extract("detail_url", r"/data/(\d+)/", 1).cast("long")
    return L.cards(nested_listing(spark, sf_dir)).select(number.alias("p_partkey"), "title", "views", "downloads", "detail_url", "provider", "category", "modified")


@query("b3_nested_counts", f"""
SELECT '자료_' || p_partkey AS title, p_partkey * 7 AS views, CAST(p_size AS BIGINT) AS downloads, '{PORTAL}/data/' || p_partkey || '/fileData.do' AS detail_url FROM part""")
def b3_nested_counts(spark, sf_dir):
    found = L.counts_cards(nested_listing(spark, sf_dir), PORTAL)
    return found.select("title", F.col("views").cast("long").alias("views"), F.col("downloads").cast("long").alias("downloads"), "detail_url")


@query("b4_nested_downloads", f"SELECT '자료_' || p_partkey AS title, '{PORTAL}/data/' || p_partkey || '/fileData.do' AS href FROM part")
def b4_nested_downloads(spark, sf_dir):
    return L.download_cards(nested_listing(spark, sf_dir), PORTAL).select("title", "href")


@query("b7_nested_tables", """
WITH f AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, c_name AS n, c_mktsegment AS m FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, CAST(0 AS BIGINT) AS ord, '제공기관' AS label, m || ' 부서 ' || n || ' 비고 ' || p || ' 끝' AS value FROM f
UNION ALL SELECT o_orderkey, 1, '부서', n FROM f UNION ALL SELECT o_orderkey, 2, '비고', p FROM f UNION ALL SELECT o_orderkey, 3, '키워드', s FROM f
UNION ALL SELECT o_orderkey, 4, '부서', n FROM f UNION ALL SELECT o_orderkey, 5, '비고', p FROM f""")
def b7_nested_tables(spark, sf_dir):
    inner = M.cat("<table>", M.row(("th", "부서"), ("td", F.col("c_name"))), M.row(("td", "비고"), ("td", F.col("o_orderpriority"))), "</table>")
    html = M.cat("<table>", M.row(("th", "제공기관"), ("td", M.cat(F.col("c_mktsegment"), inner, "끝"))), M.row(("th", "키워드"), ("td", F.col("o_orderstatus"))), "</table>")
    trees = M.order_facts(spark, sf_dir).select("o_orderkey", T.tree(H.visible(html)).alias("tree"))
    pairs = trees.select("*", DH.tables_with_headers(F.col("tree")).alias("tables")).select("o_orderkey", F.posexplode(DH.table_pairs(F.col("tree"), F.col("tables"))).alias("ord", "p"))
    return pairs.select("o_orderkey", F.col("ord").cast("long").alias("ord"), "p.label", "p.value")


@query("b13_nested_cells", """
SELECT p_partkey, CAST(1 AS BIGINT) AS seq, p_brand AS name, p_type || ' 단위 ' || p_size AS descr, 'int' AS dtype FROM part
UNION ALL SELECT p_partkey, 2, p_name, '', 'text' FROM part""")
def b13_nested_cells(spark, sf_dir):
    unit = M.cat("<table><tr><td>단위 ", F.col("p_size").cast("string"), "</td></tr></table>")
    html = M.cat(
        "<table>", M.row(("th", "항목명"), ("th", "항목 설명"), ("th", "데이터타입")), M.row(("td", F.col("p_brand")), ("td", M.cat(F.col("p_type"), unit)), ("td", "int")),
        M.row(("td", F.col("p_name")), ("td", ""), ("td", "text")), "</table>",
    )
    trees = stored(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", T.tree(H.visible(html), "tables").alias("tree"))
    tables = trees.select("p_partkey", DH.tables_with_headers(F.col("tree")).alias("tables"))
    return tables.select("p_partkey", F.posexplode(DH.column_rows(F.col("tables"))).alias("i", "r")).select("p_partkey", (F.col("i") + 1).cast("long").alias("seq"), "r.name", "r.descr", "r.dtype")


@query("b14_nested_titles", "SELECT p_partkey, 'data_ ' || p_partkey || ' 판 ' || p_size AS title FROM part")
def b14_nested_titles(spark, sf_dir):
    html = M.cat('<div class="wrap"><div class="view title"><div>data_</div><div>', F.col("p_partkey").cast("string"), " <b>판</b></div> ", F.col("p_size").cast("string"), "</div><h1>h1_x</h1></div>")
    trees = stored(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", T.tree(H.visible(html), "raw", "text", "nodes").alias("tree"))
    return trees.select("p_partkey", DH.page_title(F.col("tree")).alias("title"))


@query("b15_nested_phone", """
WITH c AS (SELECT c_custkey, c_nationkey % 6 AS k, c_mktsegment AS m, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS d FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN '02-111-' || d WHEN 1 THEN '031-222-' || d WHEN 2 THEN '' WHEN 3 THEN m || ' b' WHEN 4 THEN '042-333-' || d ELSE '' END AS phone FROM c""")
def b15_nested_phone(spark, sf_dir):
    """Label and number in different subtrees, siblings with descendants, no number within eight tags."""
    kind, label = F.col("c_nationkey") % 6, "관리부서 전화번호"
    last4 = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    html = (
        F.when(kind == 0, M.cat(f"<div><div><b>{label}</b></div><div><p><i>02-111-", last4, "</i></p></div></div>"))
        .when(kind == 1, M.cat(f"<div><b>{label}</b><div><span>담당 <em>031-222-", last4, "</em></span></div></div>"))
        .when(kind == 2, M.cat(f"<div>x<p><b>{label}</b></p></div>", "<u>a</u>" * 8, "<u>02-444-", last4, "</u>"))
        .when(kind == 3, M.cat(f"<div><b>{label}</b><i>", F.col("c_mktsegment"), "</i><i>b</i><b>보유근거</b><i>02-1-1</i></div>"))
        .when(kind == 4, M.cat(f"<table><tr><th>{label}</th><td><table><tr><td>담당</td><td>042-333-", last4, "</td></tr></table></td></tr></table>"))
        .otherwise(M.cat(f"<section>x<p><b>{label}</b></p></section><p>a b c d e f</p>"))
    )
    trees = stored(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", T.tree(H.visible(html)).alias("tree"))
    return trees.select("c_custkey", DH.department_phone(F.col("tree"), F.lit("")).alias("phone"))
