"""Queries over listing pages, addresses and the page walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import urls as U
from ..operators import listing as L
from ..plans.counts import org_counts_report
from ..sources.frontier import frontier, orgs_from_urls
from . import markup as M
from .registry import PORTAL, query, table

LISTED = """
WITH listed AS (
  SELECT p_brand AS org, p_partkey // 100 + 1 AS page_no, * FROM part
  UNION ALL SELECT p_brand, p_partkey // 100 + 2, * FROM part WHERE p_size > 40),
placed AS (
  SELECT *, replace(p_name, 'new ', '') || '_' || p_partkey AS title,
    'https://portal.example/data/' || p_partkey || '/fileData.do' AS detail_url,
    'https://portal.example/list?org=' || replace(p_brand, '#', '%23') || '&currentPage=' || page_no AS list_url,
    row_number() OVER (PARTITION BY org, page_no ORDER BY p_partkey) - 1 AS pos
  FROM listed)
"""
REACHED = LISTED + """,
firsts AS (SELECT org, p_partkey, min(page_no) AS page_no FROM listed GROUP BY ALL),
fresh AS (SELECT org, page_no, row_number() OVER (PARTITION BY org ORDER BY page_no) AS rn
          FROM (SELECT DISTINCT org, page_no FROM firsts)),
reached AS (SELECT p.* FROM placed p JOIN firsts f USING (org, p_partkey, page_no)
            JOIN fresh s USING (org, page_no) WHERE s.rn = page_no)
"""


def as_long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


BRAND_PAGES = """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, count(*) OVER (PARTITION BY p_brand) AS total FROM part),
shown AS (SELECT p_brand AS org, (n - 1) // 10 + 1 AS page_no, * FROM ranked UNION ALL SELECT p_brand, (n - 1) // 10 + 2, * FROM ranked WHERE p_size > 40),
listed AS (SELECT * FROM shown WHERE p_brand NOT LIKE '%3' OR page_no <> total // 20 + 2),
firsts AS (SELECT org, p_partkey, min(page_no) AS page_no FROM listed GROUP BY ALL),
fresh AS (SELECT org, page_no, row_number() OVER (PARTITION BY org ORDER BY page_no) AS rn FROM (SELECT DISTINCT org, page_no FROM firsts)),
reached AS (SELECT l.*, replace(p_name, 'new ', '') || '_' || p_partkey AS title, 'https://portal.example/data/' || p_partkey || '/fileData.do' AS detail_url
  FROM listed l JOIN firsts f USING (org, p_partkey, page_no) JOIN fresh s USING (org, page_no) WHERE s.rn = page_no)
"""


@query("counts_by_org", BRAND_PAGES + """
SELECT org, title, p_partkey * 7 AS views, CAST(p_size AS BIGINT) AS downloads, detail_url FROM reached""")
def counts_by_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    return org_counts_report(M.part_listing(spark, sf_dir, M.brand_pages(spark, sf_dir)), PORTAL)


@query("b3_counts_cards", LISTED + """
SELECT org, page_no, pos, title, p_partkey * 7 AS views, CAST(p_size AS BIGINT) AS downloads, detail_url, list_url FROM placed""")
def b3_counts_cards(spark, sf_dir):
    return as_long(L.counts_cards(M.part_listing(spark, sf_dir), PORTAL), "page_no", "pos")


@query("b1_cards", LISTED + """
SELECT org, page_no, pos, title AS raw_title, title, 'anchor' AS title_source, '' AS formats,
  CAST(p_partkey * 7 AS VARCHAR) AS views, CAST(p_size AS VARCHAR) AS downloads, detail_url, list_url AS source_list_url,
  p_brand AS provider, p_type AS category, CAST(NULL AS VARCHAR) AS registered, '2024.3.' || p_size AS modified FROM placed""")
def b1_cards(spark, sf_dir):
    return as_long(L.cards(M.part_listing(spark, sf_dir)), "page_no", "pos")


@query("b4_download_cards", LISTED + """
SELECT org, page_no, pos, 'CSV ' || p_name || '_' || p_partkey || ' Update' AS title, detail_url AS href,
  list_url AS source_list_url FROM placed""")
def b4_download_cards(spark, sf_dir):
    return as_long(L.download_cards(M.part_listing(spark, sf_dir), PORTAL), "page_no", "pos")


@query("b2_fallback_anchors", """
WITH a AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host,
    unnest(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 1)) AS href,
    unnest(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 2)) AS label,
    generate_subscripts(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 1), 1) AS i FROM pages),
u AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY i) AS k FROM a)
SELECT page_id, host || '/data/7/' || href AS detail_url, trim(label) AS raw_title, 'fallback_anchor' AS title_source,
  '' AS views, url AS source_list_url FROM u WHERE k = 1""")
def b2_fallback_anchors(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.lit("web").alias("org"), F.col("page_id").alias("page_no"), F.col("url").alias("list_url"), F.lit(200).alias("status"),
        F.regexp_replace("html", '<a href="/', '<a href="/data/7/').alias("html"),
    )
    cards = L.cards(M.part_listing(spark, sf_dir).withColumn("page_no", F.col("page_no").cast("long")).unionByName(pages))
    return cards.where("title_source = 'fallback_anchor'").select(
        F.col("page_no").alias("page_id"), "detail_url", "raw_title", "title_source", "views", "source_list_url"
    )


@query("b5_b6_totals", """
WITH n AS (SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
k AS (SELECT *, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN n ELSE 0 END AS announced FROM n)
SELECT c_custkey, announced,
  CASE WHEN announced > 0 THEN announced WHEN c_mktsegment = 'MACHINERY' THEN (n + 3) * 10
       WHEN c_mktsegment = 'HOUSEHOLD' THEN 10 ELSE 0 END AS total_count,
  CASE WHEN announced > 0 THEN CAST(ceil(announced / 10) AS BIGINT) WHEN c_mktsegment = 'MACHINERY' THEN n + 3
       WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS total_pages FROM k""")
def b5_b6_totals(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    n = customer.join(orders.groupBy("o_custkey").agg(F.count("*").alias("k")), customer.c_custkey == F.col("o_custkey"), "left")
    seg, k = F.col("c_mktsegment"), F.coalesce("k", F.lit(0))
    last = (k + 3).cast("string")
    html = (
        F.when(seg == "BUILDING", M.cat("<p>총 <b>", M.thousands(k), "</b> 건이 검색되었습니다</p>"))
        .when(seg == "AUTOMOBILE", M.cat("<p>총", M.thousands(k), "건</p>"))
        .when(seg == "MACHINERY", M.cat('<div class="pagination"><a onclick="go(1)">1</a><a href="#" onclick="go(', last, ')">다음</a></div>'))
        .when(seg == "HOUSEHOLD", F.lit('<p><a href="/data/1/fileData.do">x</a></p>'))
        .otherwise(F.lit('<p><a href="/other">x</a></p>'))
    )
    pages = n.select(F.col("c_custkey").cast("string").alias("org"), F.lit(1).alias("page_no"), F.lit("").alias("list_url"), html.alias("html"))
    return L.page_totals(pages).select(F.col("org").cast("long").alias("c_custkey"), "announced", "total_count", "total_pages")


@query("c1_c2_first_url", """
SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS org, regexp_replace(url, '[?#].*$', '') AS detail_url, min(page_id) AS page_no
FROM pages GROUP BY ALL""")
def c1_c2_first_url(spark, sf_dir):
    parts = U.url_parts(F.col("url"))
    pages = table(spark, sf_dir, "pages").select(
        parts["authority"].alias("org"), F.regexp_replace("url", r"[?#].*$", "").alias("detail_url"), F.col("page_id").alias("page_no"), F.lit(0).alias("pos")
    )
    return L.keep_first(pages, ["org", "detail_url"], ["page_no", "pos"]).drop("pos")


@query("c3_stop_rule", """
WITH f AS (SELECT l_suppkey AS org, CAST(l_quantity AS BIGINT) AS url, min(l_linenumber) AS page_no FROM lineitem GROUP BY ALL),
s AS (SELECT org, page_no, row_number() OVER (PARTITION BY org ORDER BY page_no) AS rn FROM (SELECT DISTINCT org, page_no FROM f))
SELECT org, url, CAST(page_no AS BIGINT) AS page_no FROM f JOIN s USING (org, page_no) WHERE rn = page_no""")
def c3_stop_rule(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("org"), F.col("l_quantity").cast("long").alias("url"), F.col("l_linenumber").alias("page_no")
    )
    first = li.groupBy("org", "url").agg(F.min("page_no").cast("long").alias("page_no"))
    return L.walk(first)


@query("c4_page_caps", """
WITH n AS (SELECT o_custkey, CAST(ceil(count(*) / 10) AS BIGINT) AS pages FROM orders GROUP BY 1)
SELECT o_custkey, pages, greatest(1, CAST(ceil(pages * 10 / 100) AS BIGINT)) + 5 AS walk_cap,
  greatest(1, CAST(ceil(pages * 10 / 1000) AS BIGINT) + 2) AS report_cap FROM n""")
def c4_page_caps(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.ceil(F.count("*") / 10).alias("pages"))
    return n.select("o_custkey", "pages", L.walk_page_cap(F.col("pages")).alias("walk_cap"), L.report_page_cap(F.col("pages")).alias("report_cap"))


@query("c4_capped_walk", """
WITH f AS (SELECT l_suppkey AS org, CAST(l_quantity AS BIGINT) AS url, min(l_linenumber) AS page_no FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL),
s AS (SELECT org, page_no, row_number() OVER (PARTITION BY org ORDER BY page_no) AS rn FROM (SELECT DISTINCT org, page_no FROM f))
SELECT org, url, CAST(page_no AS BIGINT) AS page_no FROM f JOIN s USING (org, page_no) WHERE rn = page_no""")
def c4_capped_walk(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("org"), F.col("l_quantity").cast("long").alias("url"), F.col("l_linenumber").alias("page_no")
    )
    first = L.cap_pages(li, 2).groupBy("org", "url").agg(F.min("page_no").cast("long").alias("page_no"))
    return L.walk(first)


@query("c5_item_cap", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500")
def c5_item_cap(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_custkey")
    return L.cap_items(orders, 500, ("o_orderdate", "o_orderkey")).drop("o_orderdate")


@query("c6_seq", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq FROM orders")
def c6_seq(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return L.number_items(orders, order=("o_orderdate", "o_orderkey")).drop("o_orderdate")


@query("c6_seq_by_org", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq FROM orders")
def c6_seq_by_org(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return L.number_items(orders, ("o_custkey",), ("o_orderdate", "o_orderkey")).drop("o_orderdate")


FRONTIER_SQL = "'https://portal.example" + V.LIST_PATH + "?" + "&".join(
    f"{k}=" + {"{org}": "' || replace(c_name, '#', '%23') || '", "{page}": "' || page_no || '", "{per_page}": "10", "{d_type}": "FILE",
               "{sort}": "updtDt"}.get(v, v) for k, v in V.LIST_PARAMS) + "'"
ORG_PAGES = """
WITH n AS (SELECT c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
p AS (SELECT c_name, unnest(range(1, greatest(1, CAST(ceil(n / 10) AS BIGINT)) + 1)) AS page_no FROM n)
"""


def org_totals(spark, sf_dir) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    n = orders.groupBy("o_custkey").agg(F.count("*").alias("k"))
    return customer.join(n, customer.c_custkey == n.o_custkey, "left").select(
        F.col("c_name").alias("org"), F.coalesce("k", F.lit(0).cast("long")).alias("total_count")
    )


@query("a5_frontier", ORG_PAGES + f"SELECT c_name AS org, page_no, {FRONTIER_SQL} AS list_url FROM p")
def a5_frontier(spark, sf_dir):
    return as_long(frontier(org_totals(spark, sf_dir), PORTAL, per_page=10), "page_no")


@query("f_url_builder", ORG_PAGES + "SELECT c_name AS org, page_no, 'mirror://' || c_name || '/' || page_no || '/10' AS list_url FROM p")
def f_url_builder(spark, sf_dir):
    build = lambda o, p, n: F.concat(F.lit("mirror://"), o, F.lit("/"), p.cast("string"), F.lit("/"), n.cast("string"))
    return as_long(frontier(org_totals(spark, sf_dir), PORTAL, per_page=10, url_builder=build), "page_no")


@query("a6_direct_items", """
SELECT s_name AS org, 'https://portal.example/dataset/' || s_suppkey AS detail_url, 'direct_url' AS title_source, '' AS title
FROM supplier WHERE s_nationkey < 12""")
def a6_direct_items(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    target = F.when(F.col("s_nationkey") < 12, M.cat(PORTAL + "/dataset/", key)).otherwise(M.cat(PORTAL + "/x?dataId=", key))
    targets = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("org"), target.alias("target_url"))
    return L.direct_items(targets).select("org", "detail_url", "title_source", "title")


@query("a7_org_from_url", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_name END AS org FROM customer""")
def a7_org_from_url(spark, sf_dir):
    name, seg = U.form_encode(F.col("c_name")), F.col("c_mktsegment")
    head = PORTAL + "/list?perPage=10&"
    url = (
        F.when(seg == "BUILDING", M.cat(head, "orgSearch=", name))
        .when(seg == "MACHINERY", M.cat(head, "org=&orgFilter=", name, "&orgFullName=other"))
        .when(seg == "FURNITURE", M.cat(head, "org=&orgFullName=", name))
        .when(seg == "HOUSEHOLD", M.cat(head, "org=first&org=", name))
        .otherwise(U.list_url(F.col("c_name"), F.lit(1), F.lit(10), PORTAL))
    )
    urls = table(spark, sf_dir, "customer").select("c_custkey", url.alias("url"))
    named, rejected = orgs_from_urls(urls.select("url"))
    orgs = named.select("url", "org").unionByName(rejected.select("url", F.lit(None).cast("string").alias("org")))
    return urls.join(orgs, "url").select("c_custkey", "org")


@query("d12_rewrite", """
SELECT c_custkey, CASE c_mktsegment
  WHEN 'BUILDING' THEN 'https://portal.example/data/' || c_custkey || '/fileData.do'
  WHEN 'MACHINERY' THEN 'https://portal.example/l?org=' || replace(c_name, '#', '%23') || '&perPage=1000&currentPage=' || c_nationkey
  ELSE 'https://portal.example/l?perPage=1000&q=&org=' || replace(c_name, '#', '%23') || '&currentPage=1#f' END AS list_url FROM customer""")
def d12_rewrite(spark, sf_dir):
    name, seg = U.form_encode(F.col("c_name")), F.col("c_mktsegment")
    url = (
        F.when(seg == "BUILDING", M.cat(PORTAL + "/data/", F.col("c_custkey").cast("string"), "/fileData.do"))
        .when(seg == "MACHINERY", M.cat(PORTAL + "/l?org=", name, "&perPage=10&currentPage=", F.col("c_nationkey").cast("string")))
        .otherwise(M.cat(PORTAL + "/l?perPage=3&q=&org=old&org=", name, "#f"))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", U.optimize_list_url(url, 1000).alias("list_url"))


@query("d9_absolute_url", """
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS href,
    generate_subscripts(regexp_extract_all(html, '<a href="/([^"]*)"', 1), 1) - 1 AS pos FROM pages)
SELECT page_id, pos, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' || href AS rooted,
  regexp_extract(url, '^(https?://[^?#]*/)', 1) || href AS beside,
  regexp_replace(url, '[?#].*$', '') || '?k=' || href AS queried FROM a""")
def d9_absolute_url(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))).alias("pos", "href")
    )
    base, href = F.col("url"), F.col("href")
    return links.select(
        "page_id",
        F.col("pos").cast("long").alias("pos"),
        U.absolute_url(base, M.cat("/", href)).alias("rooted"),
        U.absolute_url(base, href).alias("beside"),
        U.absolute_url(base, M.cat("?k=", href)).alias("queried"),
    )


@query("d10_d14_detail_url", """
SELECT p_partkey, p_size < 40 AS is_detail, CASE WHEN p_size < 20 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS dataset_id FROM part""")
def d10_d14_detail_url(spark, sf_dir):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    url = (
        F.when(size < 10, M.cat(PORTAL + "/data/", key, "/fileData.do"))
        .when(size < 20, M.cat(PORTAL + "/dataset/", key))
        .when(size < 30, M.cat(PORTAL + "/data/x?dataId=", key))
        .when(size < 40, M.cat(PORTAL + "/DATASET/list/fileData.do?k=", key))
        .otherwise(M.cat(PORTAL + "/tcs/dss/selectDataSetList.do?k=", key))
    )
    return table(spark, sf_dir, "part").select("p_partkey", U.is_detail_url(url).alias("is_detail"), U.dataset_id(url).alias("dataset_id"))


@query("c24_org_resolve", """
WITH c AS (SELECT s_suppkey, s_name, s_nationkey, count(c_custkey) AS n FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey GROUP BY ALL)
SELECT s_name AS user_input, CASE WHEN s_nationkey < 6 THEN s_name WHEN s_nationkey < 12 THEN s_name || '㈜'
    WHEN s_nationkey < 18 THEN '(재)' || s_name ELSE s_name END AS org_name,
  CASE WHEN s_nationkey < 18 THEN n ELSE 0 END AS total_count,
  CASE WHEN s_nationkey < 18 AND n > 0 THEN CAST(ceil(n / 10) AS BIGINT) ELSE 0 END AS total_pages FROM c WHERE n > 0""")
def c24_org_resolve(spark, sf_dir):
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    n = customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    known = supplier.join(n, supplier.s_nationkey == n.c_nationkey)
    name, nation = F.col("s_name"), F.col("s_nationkey")
    registered = known.where(nation < 18).select(
        F.when(nation < 6, name).when(nation < 12, M.cat(name, "㈜")).otherwise(M.cat("(재)", name)).alias("org_name"),
        F.col("n").alias("total_count"),
    )
    # A later spelling of the same supplier must lose to an earlier one.
    decoys = known.where(nation < 6).select(M.cat(name, "(주)").alias("org_name"), F.lit(999).cast("long").alias("total_count"))
    resolved = L.resolve_orgs(known.select(M.cat(" ", name, " ").alias("user_input")), registered.unionByName(decoys), PORTAL)
    return resolved.select(F.trim("user_input").alias("user_input"), "org_name", "total_count", "total_pages")
