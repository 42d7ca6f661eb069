"""Queries over detail pages: pairs, columns, titles, phones, validity, whole rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import detail_html as DH
from ..functions import html as H
from ..functions import text as X
from ..functions import tree as T
from ..operators import attempts as A
from ..operators import detail as D
from ..operators import fields as P
from ..operators import merge as G
from ..plans.metadata import collect_details
from . import markup as M
from .registry import PORTAL, query, stored, table

FACTS = """
WITH f AS (SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority, CAST(floor(o_totalprice) AS BIGINT) AS total,
  c_name, c_mktsegment, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey)
"""
SHORT_DATE = "year(o_orderdate) || '.' || month(o_orderdate) || '.' || day(o_orderdate)"


def pair_rows(df, pairs):
    return df.select("o_orderkey", F.posexplode(pairs).alias("ord", "p")).select(
        "o_orderkey", F.col("ord").cast("long").alias("ord"), "p.label", "p.value"
    )


@query("b7_b8_pairs", FACTS + f"""
SELECT o_orderkey, CAST(0 AS BIGINT) AS ord, '제공기관' AS label, c_mktsegment AS value FROM f
UNION ALL SELECT o_orderkey, 1, '관리부서명', c_name FROM f
UNION ALL SELECT o_orderkey, 2, '등록일', {SHORT_DATE} FROM f
UNION ALL SELECT o_orderkey, 3, '키워드', o_orderpriority FROM f
UNION ALL SELECT o_orderkey, 4, '매체유형', o_orderstatus || ' &' FROM f""")
def b7_b8_pairs(spark, sf_dir):
    pages = M.order_facts(spark, sf_dir).select("o_orderkey", T.tree(H.visible(M.th_td_table())).alias("tree"))
    tables = pages.select("*", DH.tables_with_headers(F.col("tree")).alias("tables"))
    return pair_rows(tables, DH.table_pairs(F.col("tree"), F.col("tables")))


@query("b9_dl_pairs", FACTS + """
SELECT o_orderkey, CAST(0 AS BIGINT) AS ord, '전체 행' AS label, format('{:,}', total) || ' 건' AS value FROM f
UNION ALL SELECT o_orderkey, 1, '업데이트 주기', o_orderpriority FROM f""")
def b9_dl_pairs(spark, sf_dir):
    pages = M.order_facts(spark, sf_dir).select("o_orderkey", T.tree(H.visible(M.dl_list())).alias("tree"))
    return pair_rows(pages, DH.dl_pairs(F.col("tree")))


BLOCK_SQL = """'파일데이터명 ' || c_name || '_' || o_orderkey || ' 분류체계 ' || c_mktsegment || ' - ' || o_orderstatus || ' 제공기관 ' || c_name
  || ' 관리부서 전화번호 02-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '-0001 보유근거 수집방법 ' || o_orderpriority || ' 활용신청 버튼 '"""


@query("b10_block", FACTS + f"SELECT o_orderkey, {BLOCK_SQL} AS block FROM f")
def b10_block(spark, sf_dir):
    pages = M.order_facts(spark, sf_dir).select("o_orderkey", H.text_of(H.visible(M.block_text())).alias("text"))
    return pages.select("o_orderkey", DH.text_block(F.col("text")).alias("block"))


@query("b11_block_pairs", FACTS + """
SELECT o_orderkey, CAST(0 AS BIGINT) AS ord, '파일데이터명' AS label, c_name || '_' || o_orderkey AS value FROM f
UNION ALL SELECT o_orderkey, 1, '분류체계', c_mktsegment || ' - ' || o_orderstatus FROM f
UNION ALL SELECT o_orderkey, 2, '제공기관', c_name FROM f
UNION ALL SELECT o_orderkey, 3, '관리부서 전화번호', '02-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '-0001' FROM f
UNION ALL SELECT o_orderkey, 4, '보유근거', '' FROM f
UNION ALL SELECT o_orderkey, 5, '수집방법', o_orderpriority FROM f""")
def b11_block_pairs(spark, sf_dir):
    pages = M.order_facts(spark, sf_dir).select("o_orderkey", H.text_of(H.visible(M.block_text())).alias("text"))
    blocks = pages.select("o_orderkey", DH.text_block(F.col("text")).alias("block"))
    return pair_rows(blocks, DH.block_pairs(F.col("block")))


LINES = """
WITH l AS (SELECT l_orderkey, 'p' || l_partkey AS name, strftime(l_shipdate, '%Y-%m-%d') AS descr, l_returnflag AS dtype,
  CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS length,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem)
"""


@query("b12_b13_columns", LINES + "SELECT l_orderkey, seq, name, descr, dtype, length FROM l")
def b12_b13_columns(spark, sf_dir):
    trees = M.order_columns(spark, sf_dir).select("l_orderkey", T.tree(F.col("columns_html"), "tables").alias("tree"))
    pages = trees.select("l_orderkey", DH.tables_with_headers(F.col("tree")).alias("tables"))
    rows = pages.select("l_orderkey", F.posexplode(DH.column_rows(F.col("tables"))).alias("i", "r"))
    return rows.select("l_orderkey", (F.col("i") + 1).cast("long").alias("seq"), "r.*")


@query("b12_header_kinds", """
SELECT p_partkey, CASE WHEN p_size <= 10 THEN '1:1:2:3:0' WHEN p_size <= 20 THEN '1:1:2:0:0' WHEN p_size <= 30 THEN '2:2:0:1:3'
  ELSE '' END AS header FROM part""")
def b12_header_kinds(spark, sf_dir):
    def head(*names):
        return M.row(*[("th", n) for n in names])

    size = F.col("p_size")
    table_html = M.cat(
        "<table>",
        F.when(size <= 10, head("컬럼명", "설명", "타입"))
        .when(size <= 20, head("항목명", "항목 설명"))
        .when(size <= 30, M.cat(M.row(("td", "제목")), head("데이터 타입", "필드명", "길이")))
        .when(size <= 40, head("항목명", "길이"))
        .otherwise(M.cat(*[M.row(("td", "x"), ("td", "y"))] * 4, head("항목명", "데이터타입"))),
        M.row(("td", F.col("p_name")), ("td", F.col("p_type"))),
        "</table>",
    )
    trees = stored(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", T.tree(table_html, "tables").alias("tree"))
    rows = trees.select("p_partkey", F.get(DH.table_rows(F.col("tree")), F.lit(0)).alias("rows"))
    h = DH.column_header(F.col("rows"))
    keys = ("row", "name", "descr", "dtype", "length")
    return rows.select("p_partkey", h.alias("h")).select(
        "p_partkey", F.when(F.col("h").isNull(), "").otherwise(F.concat_ws(":", *[F.col(f"h.{k}").cast("string") for k in keys])).alias("header")
    )


@query("c14_column_list", LINES + """
, d AS (SELECT l_orderkey, name, min(seq) AS first_seq FROM l GROUP BY ALL)
SELECT l_orderkey, string_agg(name, ', ' ORDER BY first_seq) AS column_list FROM d GROUP BY 1""")
def c14_column_list(spark, sf_dir):
    trees = M.order_columns(spark, sf_dir).select("l_orderkey", T.tree(F.col("columns_html"), "tables").alias("tree"))
    pages = trees.select("l_orderkey", DH.tables_with_headers(F.col("tree")).alias("tables"))
    return pages.select("l_orderkey", DH.column_rows(F.col("tables")).alias("c")).select(
        "l_orderkey", DH.column_list(F.col("c")).alias("column_list")
    )


@query("c13_c15_column_output", LINES + """
SELECT 'order ' || o_orderkey AS dataset_name, CASE WHEN name IS NULL THEN '' ELSE 'u' || o_orderkey END AS detail_url,
  coalesce(CAST(seq AS VARCHAR), '') AS seq_in_page, coalesce(name, '') AS name, coalesce(descr, '') AS descr,
  coalesce(dtype, '') AS dtype, coalesce(length, '') AS length
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def c13_c15_column_output(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    pages = stored(orders.join(M.order_columns(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left"), "o_orderkey")
    trees = pages.select("o_orderkey", T.tree(H.visible(F.col("columns_html")), "tables").alias("tree"))
    tables = trees.select("o_orderkey", DH.tables_with_headers(F.col("tree")).alias("tables"))
    rows = tables.select(
        M.cat("order ", F.col("o_orderkey").cast("string")).alias("dataset_name"),
        M.cat("u", F.col("o_orderkey").cast("string")).alias("detail_url"),
        DH.column_rows(F.col("tables")).alias("columns"),
    )
    return D.column_output(rows)


LINE_KEY = "lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') || lpad(CAST(l_partkey AS VARCHAR), 12, '0') || lpad(CAST(l_suppkey AS VARCHAR), 12, '0')"


def line_key():
    parts = [("l_orderkey", 12), ("l_linenumber", 4), ("l_partkey", 12), ("l_suppkey", 12)]
    return F.concat(*[F.lpad(F.col(c).cast("string"), n, "0") for c, n in parts])


@query("c16_normalise", f"""
WITH l AS (SELECT {LINE_KEY} AS line_no, 'u' || l_orderkey AS detail_url, * FROM lineitem),
k AS (SELECT *, l_returnflag <> 'A' AS real_row, row_number() OVER (PARTITION BY l_returnflag <> 'A', detail_url ORDER BY line_no) AS n FROM l)
SELECT line_no, 'd' || l_orderkey AS dataset_name, CASE WHEN real_row THEN detail_url ELSE '' END AS detail_url,
  CASE WHEN real_row THEN CAST(n AS VARCHAR) ELSE '' END AS seq_in_page, CASE WHEN real_row THEN 'p' || l_partkey ELSE '' END AS name,
  CASE WHEN NOT real_row THEN '' WHEN l_linestatus = 'O' THEN 'old' ELSE 'new' END AS descr,
  CASE WHEN real_row THEN l_returnflag ELSE '' END AS dtype, CASE WHEN real_row THEN '7' ELSE '' END AS length FROM k""")
def c16_normalise(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    real, key = F.col("l_returnflag") != "A", F.col("l_orderkey").cast("string")

    def only(c):
        return F.when(real, c).otherwise("")

    stored = li.select(
        line_key().alias("line_no"),
        M.cat("d", key).alias("dataset_name"),
        M.cat("u", key).alias("detail_url"),
        F.when(F.col("l_returnflag") == "R", "x").otherwise(F.col("l_linenumber").cast("string")).alias("seq_in_page"),
        only(M.cat("p", F.col("l_partkey").cast("string"))).alias("name"),
        only(F.when(F.col("l_linestatus") == "O", " ").otherwise("new")).alias("descr"),
        only(F.lit("old")).alias("legacy_descr"),
        only(F.col("l_returnflag")).alias("dtype"),
        only(F.lit("7")).alias("legacy_length"),
    )
    return G.normalize_columns(stored)


@query("b14_title", f"""
WITH w AS (SELECT page_id, trim(regexp_replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&amp;', '&'), '\\s+', ' ', 'g')) AS t FROM pages),
h AS (SELECT page_id, trim(regexp_replace(regexp_replace(t, '(?i){V.TITLE_BADGES}', ''), '(?i)\\bnew\\b', '', 'g')) AS t FROM w)
SELECT page_id, CASE WHEN contains(t, '_') OR length(t) > 10 THEN t ELSE 'fallback' END AS title FROM h""")
def b14_title(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", T.tree(H.visible(F.col("html"))).alias("tree"))
    return pages.select("page_id", DH.detail_title(DH.page_title(F.col("tree")), F.lit("fallback")).alias("title"))


@query("b14_title_order", """
SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'data_' || p_partkey WHEN p_size <= 20 THEN 'h1_' || p_partkey
  WHEN p_size <= 30 THEN 'twelve chars ' || p_partkey WHEN p_size <= 40 THEN 'head_' || p_partkey ELSE p_type END AS title FROM part""")
def b14_title_order(spark, sf_dir):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    html = (
        F.when(size <= 10, M.cat("<h1>h1_x</h1><div class='a data-title b'>data_", key, "</div>"))
        .when(size <= 20, M.cat('<p class="subtitle">no_match</p><h2>h2_x</h2><h1>데이터 상세</h1><h1> CSV h1_', key, "</h1>"))
        .when(size <= 30, M.cat("<h1>짧다</h1><h3 class='title-x'>twelve chars ", key, " | 공공데이터포털</h3>"))
        .when(size <= 40, M.cat("<head><title>head_", key, "</title></head><h1>회원가입</h1>"))
        .otherwise(F.lit("<h1>회원가입</h1><h2>short</h2>"))
    )
    trees = stored(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", "p_type", T.tree(html, "raw", "text", "nodes").alias("tree"))
    return trees.select("p_partkey", DH.detail_title(DH.page_title(F.col("tree")), F.col("p_type")).alias("title"))


@query("b15_phone", """
SELECT c_custkey, CASE WHEN c_nationkey < 4 THEN '02-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-1111'
  WHEN c_nationkey < 8 THEN '031-222-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')
  WHEN c_nationkey < 12 THEN '' WHEN c_nationkey < 16 THEN '051333' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')
  WHEN c_nationkey < 20 THEN '042-444-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN c_nationkey < 23 THEN '1566-0025'
  ELSE c_mktsegment END AS phone FROM customer""")
def b15_phone(spark, sf_dir):
    last4 = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    nation = F.col("c_nationkey")
    label = "관리부서 전화 번호"
    html = (
        F.when(nation < 4, M.cat("<table>", M.row(("th", label), ("th", "x"), ("td", M.cat("<i>02)", last4, "-1111</i>"))), "</table>"))
        .when(nation < 8, M.cat("<table>", M.row(("th", label), ("td", M.cat("<span id=t></span><script>$('#t').text('031-222-", last4, "')</script>"))), "</table>"))
        .when(nation < 12, M.cat("<table>", M.row(("th", label), ("td", "<span></span>")), "</table><p>대표 1566-0025</p>"))
        .when(nation < 16, M.cat("<div><strong>", label, "</strong><i><em data-tel='051 333 ", last4, "'></em></i></div>"))
        .when(nation < 20, M.cat("<p>파일데이터명 a 분류체계 b 제공기관 c ", label, ": 042.444.", last4, " 보유근거 없음</p>"))
        .when(nation < 23, M.cat("<dl><dt>담당부서 전화번호<dd>관리기관 1566-0025</dl>"))
        .otherwise(M.cat("<div><b>", label, "</b><b>", F.col("c_mktsegment"), "</b><b>보유근거</b><b>02-1-1</b></div>"))
    )
    pages = stored(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", T.tree(H.visible(html)).alias("tree"))
    texts = pages.select("*", DH.text_block(T.page_text(F.col("tree"))).alias("block"))
    return texts.select("c_custkey", DH.department_phone(F.col("tree"), F.col("block")).alias("phone"))


@query("b16_download_count", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN CAST(o_custkey AS VARCHAR) WHEN 'F' THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS downloads FROM orders""")
def b16_download_count(spark, sf_dir):
    status = F.col("o_orderstatus")
    text = (
        F.when(status == "P", M.cat("다운로드 3 다운로드 (바로가기) ", M.thousands(F.col("o_custkey"))))
        .when(status == "F", M.cat("다운로드 9 다운로드수 ", F.col("o_orderkey").cast("string")))
        .otherwise(F.lit("내려받기 5"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", DH.detail_download_count(text).alias("downloads"))


@query("b17_invalid", """
SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'UNAVAILABLE_PAGE:잘못된 접근입니다' WHEN 2 THEN 'DATASET_LIST_PAGE'
  WHEN 4 THEN 'UNAVAILABLE_PAGE:페이지를 찾을 수 없습니다' WHEN 5 THEN 'EMPTY_BODY' ELSE '' END AS reason FROM pages""")
def b17_invalid(spark, sf_dir):
    case = F.col("page_id") % 6
    said = (
        F.when(case == 1, "<p>잘못된 접근입니다</p>")
        .when(case == 2, "<p>데이터목록 조건검색 총 3건이 검색되었습니다</p><p>잘못된 접근입니다</p>")
        .when(case == 3, "<p>파일데이터명 a 분류체계 b 제공기관 c 설명 잘못된 접근입니다</p>")
        .when(case == 4, "<p>접근 권한이 없습니다 페이지를 찾을 수 없습니다</p>")
        .otherwise("")
    )
    html = F.when(case == 5, F.concat(F.lit("<!-- "), F.regexp_replace("html", "-->", " "), F.lit(" -->"))).otherwise(
        F.regexp_replace("html", "<body>", F.concat(F.lit("<body>"), said))
    )
    texts = table(spark, sf_dir, "pages").select("page_id", H.text_of(H.visible(html)).alias("text"))
    return texts.select("page_id", DH.invalid_reason(F.col("text"), DH.text_block(F.col("text"))).alias("reason"))


@query("c8_classify", """
WITH e AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 429 WHEN 'purchase' THEN 503 WHEN 'click' THEN 404 ELSE 200 END AS status,
  CAST(floor(value * 10) AS BIGINT) AS n, event_type = 'error' AS blocked FROM events),
t AS (SELECT *, 7 + n + CASE WHEN blocked THEN 18 ELSE 0 END AS chars FROM e)
SELECT event_id, CASE WHEN status IN (429, 503) THEN 'HTTP status=' || status
  WHEN chars < 500 THEN 'EMPTY_OR_SHORT_HTML status=' || status || ', len=' || chars
  WHEN blocked THEN 'BLOCK_SIGNAL: Too Many Requests' END AS error FROM t""")
def c8_classify(spark, sf_dir):
    kind = F.col("event_type")
    body = F.repeat(F.lit("a"), F.floor(F.col("value") * 10).cast("int"))
    pages = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("url"),
        F.when(kind == "signup", 429).when(kind == "purchase", 503).when(kind == "click", 404).otherwise(200).alias("status"),
        M.cat("<p>", F.when(kind == "error", "Too Many Requests ").otherwise(""), body, "</p>").alias("html"),
    )
    return D.page_texts(pages).select(F.col("url").cast("long").alias("event_id"), "error")


ATTEMPTS = """
WITH a AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS detail_url, hour(ts) // 6 + 1 AS attempt,
  CASE event_type WHEN 'signup' THEN 429 WHEN 'purchase' THEN 503 ELSE 200 END AS status, value * 10 AS chars, event_type = 'error' AS sig FROM events),
k AS (SELECT *, status = 429 OR (status = 200 AND chars >= 500 AND sig) AS block, status = 200 AND chars < 500 AS short,
  status = 200 AND chars >= 500 AND NOT sig AS ok FROM a)
"""


def event_attempts(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "signup", 429).when(kind == "purchase", 503).otherwise(200)
    flags = A.attempt_flags(status, F.col("value") * 10, F.when(kind == "error", "captcha").otherwise(""))
    return table(spark, sf_dir, "events").select(
        M.cat(F.col("user_id").cast("string"), "-", F.date_format("ts", "yyyyMMdd")).alias("detail_url"),
        (F.floor(F.hour("ts") / 6) + 1).cast("long").alias("attempt"),
        *[c.alias(n) for n, c in flags.items()],
    )


@query("c9_routing", ATTEMPTS + """
, per AS (SELECT detail_url, attempt, bool_or(ok) AS ok, bool_or(block) AS block, bool_or(short) AS short FROM k GROUP BY ALL),
d AS (SELECT detail_url, min(CASE WHEN ok OR block THEN attempt END) AS first_decided, max(attempt) AS last_at FROM per GROUP BY 1)
SELECT d.detail_url, CASE WHEN f.ok THEN 'success' WHEN f.block THEN 'deferred_block' WHEN l.short THEN 'deferred_short_html' ELSE 'failed' END AS outcome,
  coalesce(first_decided, last_at) AS decided_at,
  CASE WHEN f.ok THEN '' WHEN f.block THEN 'deferred_block_httpx' WHEN l.short THEN 'deferred_short_html_httpx' ELSE 'fetch_detail_httpx' END AS stage,
  CASE WHEN f.ok THEN '' WHEN f.block THEN 'deferred_saved_only' WHEN l.short THEN 'playwright_fallback_failed' ELSE 'fetch_detail_httpx' END AS saved_as
FROM d LEFT JOIN per f ON f.detail_url = d.detail_url AND f.attempt = first_decided JOIN per l ON l.detail_url = d.detail_url AND l.attempt = last_at""")
def c9_routing(spark, sf_dir):
    return A.route(event_attempts(spark, sf_dir)).withColumn("saved_as", A.saved_stage(F.col("outcome")))


@query("c7_candidates", """
SELECT p_partkey, CAST(CASE WHEN p_size % 4 = 3 THEN NULL WHEN p_size > 30 AND p_size % 4 = 0 THEN 2 ELSE p_size % 4 END AS BIGINT) AS used FROM part""")
def c7_candidates(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    forms = [
        M.cat("https://h.example/data/", key, "/fileData.do"),
        M.cat(PORTAL + "/dataset/", key, "/fileData.do?lang=ko"),
        M.cat(PORTAL + "/data/", key, "/fileData.do"),
    ]
    # Good page under the form p_size % 4 (none for 3). Big parts answer the original form with
    # an error and offer the last form too.
    good = size % 4
    page = F.explode(F.array(*[F.struct(F.lit(i).alias("form"), f.alias("url")) for i, f in enumerate(forms)]))
    pages = part.select("p_size", page.alias("p")).select("p.form", "p.url", "p_size")
    usable = (F.col("form") == F.col("p_size") % 4) | ((F.col("p_size") > 30) & (F.col("form") == 2) & (F.col("p_size") % 4 != 3))
    broken = (F.col("p_size") > 30) & (F.col("form") == 0)
    parsed = pages.where(usable | broken).select(
        "url", F.when(broken, "HTTP status=503").alias("error"), F.col("form").alias("form")
    )
    items = part.select("p_partkey", forms[0].alias("detail_url"))
    found, missed = A.split_chosen(A.choose_response(items, parsed, PORTAL))
    return found.select("p_partkey", F.col("page.form").cast("long").alias("used")).unionByName(
        missed.select("p_partkey", F.lit(None).cast("long").alias("used"))
    )


SPELLINGS = [(n, t) for t, names in V.LABEL_SPELLINGS.items() for n in names]
LABEL_VALUES = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(SPELLINGS))


@query("c10_label_map", f"""
WITH m(i, label, target) AS (VALUES {LABEL_VALUES})
SELECT event_id, CASE WHEN label = '다운로드(바로가기)' AND event_id % 3 <> 0 THEN NULL ELSE target END AS target
FROM events LEFT JOIN m ON i = event_id % {len(SPELLINGS) + 3}""")
def c10_label_map(spark, sf_dir):
    names = F.array(*[F.lit(n) for n, _ in SPELLINGS], *[F.lit(f"모름{i}") for i in range(3)])
    label = F.get(names, (F.col("event_id") % (len(SPELLINGS) + 3)).cast("int"))
    case = F.col("event_id") % 3
    dressed = F.when(case == 0, label).when(case == 1, M.cat(" ", label, " :")).otherwise(M.cat("[", label, "]"))
    return table(spark, sf_dir, "events").select("event_id", P.target_of(dressed).alias("target"))


@query("c11_merge", """
WITH p AS (SELECT user_id, ts, CASE event_type WHEN 'view' THEN 'provider' WHEN 'click' THEN 'legal_basis' WHEN 'signup' THEN 'dept_phone'
    WHEN 'purchase' THEN 'formats' WHEN 'error' THEN 'dataset_name' END AS target,
  CASE WHEN value > 200 THEN '' WHEN value < 20 AND event_type IN ('view', 'click') THEN '시간범위'
    WHEN event_type = 'signup' AND value < 15 THEN '담당자 ' || event_id
    WHEN event_type = 'signup' AND value < 30 THEN '관리기관 1566-0025'
    WHEN event_type = 'signup' THEN '02-' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') || '1234'
    WHEN event_type = 'purchase' THEN 'CSV ' || event_id ELSE 'v' || event_id END AS value FROM events),
k AS (SELECT *, value LIKE '02-%' AS has_phone FROM p WHERE value <> '' AND value <> '관리기관 1566-0025')
SELECT user_id,
  coalesce(arg_min(value, ts) FILTER (target = 'provider' AND value <> '시간범위'), arg_max(value, ts) FILTER (target = 'provider'), '') AS provider,
  coalesce(arg_min(value, ts) FILTER (target = 'legal_basis' AND value <> '시간범위'), arg_max(value, ts) FILTER (target = 'legal_basis'), '') AS legal_basis,
  coalesce(arg_max(value, ts) FILTER (target = 'dept_phone' AND has_phone), arg_min(value, ts) FILTER (target = 'dept_phone'), '') AS dept_phone,
  coalesce(arg_max(value, ts) FILTER (target = 'formats'), '') AS formats,
  coalesce(arg_min(value, ts) FILTER (target = 'dataset_name'), '') AS dataset_name, '' AS downloads
FROM k GROUP BY user_id""")
def c11_merge(spark, sf_dir):
    kind, value, key = F.col("event_type"), F.col("value"), F.col("event_id").cast("string")
    label = (
        F.when(kind == "view", " 제공기관 ").when(kind == "click", "보유 근거").when(kind == "signup", "담당부서 전화 번호:")
        .when(kind == "purchase", "파일형식").otherwise("파일데이터명")
    )
    text = (
        F.when(value > 200, " ")
        .when((value < 20) & kind.isin("view", "click"), "시간범위")
        .when((kind == "signup") & (value < 15), M.cat("담당자 ", key))
        .when((kind == "signup") & (value < 30), "관리기관 1566-0025")
        .when(kind == "signup", M.cat("02) ", F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0"), " 1234"))
        .when(kind == "purchase", M.cat("CSV,", key))
        .otherwise(M.cat("v", key))
    )
    pairs = table(spark, sf_dir, "events").select(F.col("user_id").alias("detail_url"), "ts", label.alias("label"), text.alias("value"))
    extra = table(spark, sf_dir, "events").select(F.col("user_id").alias("detail_url"), "ts", F.lit("다운로드수").alias("label"), key.alias("value"))
    merged = P.merge_pairs(pairs.unionByName(extra), ["ts"])
    return merged.select(F.col("detail_url").alias("user_id"), "provider", "legal_basis", "dept_phone", "formats", "dataset_name", "downloads")


@query("c12_minimal_name", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN c_name WHEN 'MACHINERY' THEN 'raw ' || c_custkey
  WHEN 'FURNITURE' THEN '상세페이지 확인필요_' || c_custkey ELSE '상세페이지 확인필요_' || (c_custkey + 5) END AS dataset_name FROM customer""")
def c12_minimal_name(spark, sf_dir):
    seg, key = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    title = F.when(seg == "BUILDING", M.cat("CSV ", F.col("c_name"), " Update")).when(seg == "MACHINERY", "로그인").otherwise("")
    raw = F.when(seg == "MACHINERY", M.cat("raw ", key)).otherwise("데이터 목록")
    url = F.when(seg == "FURNITURE", M.cat(PORTAL + "/data/", key)).otherwise(M.cat(PORTAL + "/view?no=", key))
    return table(spark, sf_dir, "customer").select("c_custkey", D.minimal_name(X.list_title(title, raw), url, F.col("c_custkey") + 5).alias("dataset_name"))


DETAIL_SQL = LINES + f""",
f AS (SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority, CAST(floor(o_totalprice) AS BIGINT) AS total, c_name, c_mktsegment, c_custkey
  FROM orders JOIN customer ON o_custkey = c_custkey),
d AS (SELECT l_orderkey, name, min(seq) AS first_seq FROM l GROUP BY ALL),
cl AS (SELECT l_orderkey, string_agg(name, ', ' ORDER BY first_seq) AS column_list FROM d GROUP BY 1),
r AS (SELECT *, o_orderstatus = 'P' AS bad FROM f LEFT JOIN cl ON l_orderkey = o_orderkey),
metadata AS (
SELECT o_orderkey + 1 AS seq, c_name || '_' || o_orderkey AS dataset_name, CASE WHEN bad THEN '' ELSE c_mktsegment END AS provider,
  '목록분류' AS category, 'CSV' AS formats, CASE WHEN bad THEN '' ELSE CAST(total AS VARCHAR) END AS total_rows,
  CASE WHEN bad THEN '' ELSE o_orderpriority END AS keywords, '' AS description, CASE WHEN bad THEN '' ELSE coalesce(column_list, '') END AS column_list,
  'https://portal.example/data/' || o_orderkey || '/fileData.do' AS detail_url, CASE WHEN bad THEN '' ELSE c_name END AS dept,
  CASE WHEN bad THEN '' ELSE '02-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '-0001' END AS dept_phone,
  '' AS legal_basis, CASE WHEN bad THEN '' ELSE o_orderpriority END AS collect_method, CASE WHEN bad THEN '' ELSE o_orderpriority END AS update_cycle,
  '' AS next_due, CASE WHEN bad THEN '' ELSE o_orderstatus || ' &' END AS media_type,
  CASE WHEN bad THEN '상세페이지가 정상 파일데이터 상세화면이 아니어서 목록 수집값 기준으로 저장했습니다. [UNAVAILABLE_PAGE:잘못된 접근입니다]' ELSE '' END AS data_limit,
  CAST(o_orderkey * 7 AS VARCHAR) AS views, CAST(c_custkey AS VARCHAR) AS downloads,
  CASE WHEN bad THEN '' WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE {SHORT_DATE} END AS registered, '2024-01-05' AS modified, '' AS provide_type, '' AS notes,
  '' AS spatial, '' AS temporal, '' AS fee, '' AS fee_basis, '' AS license, '실시간수집' AS source_label FROM r)
"""


@query("b18_detail_rows", DETAIL_SQL + "SELECT * FROM metadata")
def b18_detail_rows(spark, sf_dir):
    pages = M.order_pages(spark, sf_dir).drop("o_orderkey")
    return collect_details(M.order_items(spark, sf_dir), pages, PORTAL, "2024-01-01 00:00:00").metadata


@query("c31_fail_rows", """
SELECT '2024-01-01 00:00:00' AS collected_at, 'fetch_detail_httpx' AS stage, c_name AS dataset_name, 'https://portal.example/dataset/' || c_custkey AS url,
  CAST(c_custkey AS VARCHAR) AS seq, '7' AS views, CASE WHEN c_nationkey < 10 THEN '3' ELSE '9' END AS downloads,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'NO_RESPONSE' ELSE 'HTTP status=403' END || ', url=https://portal.example/dataset/' || c_custkey AS error, '' AS traceback FROM customer""")
def c31_fail_rows(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    url = M.cat(PORTAL + "/dataset/", F.col("c_custkey").cast("string"))
    items = customer.select(
        url.alias("detail_url"), F.col("c_custkey").alias("seq"), F.lit(" ").alias("title"), F.col("c_name").alias("raw_title"), F.lit("7").alias("views"),
        F.when(F.col("c_nationkey") < 10, "3").otherwise("").alias("downloads"), F.lit("9").alias("download_count"),
    ).withColumn("title", F.lit(""))
    parsed = customer.where("c_mktsegment <> 'BUILDING'").select(url.alias("url"), F.lit("HTTP status=403").alias("error"), F.lit(1).alias("any"))
    _, missed = A.split_chosen(A.choose_response(items, parsed, PORTAL))
    return A.fail_rows(missed, "fetch_detail_httpx", "2024-01-01 00:00:00")
