"""Queries over the scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import text as X
from . import markup as M
from .registry import query, table


@query("d1_d2_d3_text", """
SELECT p_partkey, p_name || ' ' || p_type AS cleaned, replace(p_name, ' ', '') || p_type AS keyed, p_name || '_' || p_type AS filed,
  CASE WHEN p_size > 25 THEN p_brand ELSE 'unnamed' END AS named FROM part""")
def d1_d2_d3_text(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    noisy = M.cat("　", F.replace("p_name", F.lit(" "), F.lit("  \t ")), "\n ", F.col("p_type"), " ")
    return part.select(
        "p_partkey",
        X.clean_text(noisy).alias("cleaned"),
        X.norm_key(M.cat("[", F.col("p_name"), "] : ", F.col("p_type"), "·/-")).alias("keyed"),
        X.clean_filename(M.cat(" ", F.col("p_name"), "/", F.col("p_type"))).alias("filed"),
        X.clean_filename(F.when(F.col("p_size") > 25, F.col("p_brand"))).alias("named"),
    )


@query("d4_title", """
SELECT p_partkey, replace(p_name, 'new ', '') || '_' || p_partkey AS title, '[' || p_brand || '_' || p_partkey || ']' AS counts_title,
  p_brand || '_' || p_partkey AS unwrapped, p_brand || ' ' || p_partkey AS undated, lower(replace(p_brand, ' ', '')) || p_partkey AS compared FROM part""")
def d4_title(spark, sf_dir):
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    badge = F.get(F.array(*[F.lit(b) for b in ("CSV JSON + XML ", "파일데이터 ", "xlsx,PDF / ", "Update ", "")]), (F.col("p_size") % 5).cast("int"))
    tail = F.get(F.array(*[F.lit(t) for t in (" Update", " 제공기관 x 조회수 9", " | 공공데이터포털", "", " 업데이트")]), (F.col("p_partkey") % 5).cast("int"))
    name, wrapped = M.cat(F.col("p_name"), "_", key), M.cat("[", F.col("p_brand"), "_", key, "]")
    dated = M.cat("ZIP ", F.col("p_brand"), " ", key, "_20240131")
    return part.select(
        "p_partkey",
        X.clean_dataset_title(M.cat(badge, name, tail)).alias("title"),
        X.clean_dataset_title(wrapped, unwrap=False).alias("counts_title"),
        X.clean_dataset_title(wrapped).alias("unwrapped"),
        X.strip_date_suffix(dated).alias("undated"),
        X.title_for_compare(dated).alias("compared"),
    )


@query("d7_menu", f"""
SELECT p_partkey, p_size <= {len(V.MENU_WORDS)} OR p_size > 45 AS is_menu FROM part""")
def d7_menu(spark, sf_dir):
    size = F.col("p_size")
    word = F.get(F.array(*[F.lit(f" {w} :") for w in V.MENU_WORDS]), size - 1)
    inside = M.cat("온비드 ", F.lit(V.MENU_WORDS[10]), " 현황 ", F.col("p_name"))
    text = F.when(size <= len(V.MENU_WORDS), word).when(size > 48, M.cat("x ", V.MENU_PHRASES[1], " y")).when(size > 45, " ").otherwise(inside)
    return table(spark, sf_dir, "part").select("p_partkey", X.is_menu_title(text).alias("is_menu"))


@query("d8_title_choice", """
SELECT p_partkey, CASE WHEN p_size <= 10 THEN replace(p_name, 'new ', '') WHEN p_size <= 20 THEN p_brand WHEN p_size <= 30 THEN replace(p_name, 'new ', '')
  WHEN p_size <= 40 THEN p_type ELSE p_brand END AS title FROM part""")
def d8_title_choice(spark, sf_dir):
    size = F.col("p_size")
    title = F.when((size > 30) & (size <= 40), "로그인").when(size > 40, "").otherwise(F.col("p_name"))
    raw = F.when((size > 30) & (size <= 40), F.col("p_type")).when(size > 40, " ").otherwise(F.col("p_name"))
    source = F.when(size <= 10, "anchor").when((size > 30) & (size <= 40), "detail_anchor").otherwise("title_selector")
    detail = F.when((size > 20) & (size <= 30), M.cat(F.replace("p_name", F.lit(" "), F.lit("  ")), "_20240101")).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", X.dataset_title(title, raw, source, detail).alias("title"))


@query("d11_short_error", """
SELECT event_id, event_type IN ('error', 'signup') AS is_short FROM events""")
def d11_short_error(spark, sf_dir):
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", M.cat("RuntimeError('EMPTY_OR_SHORT_HTML status=200, len=", F.col("event_id").cast("string"), "')"))
        .when(kind == "signup", "RETRY_FAILED_EMPTY_OR_SHORT_HTML")
        .when(kind == "view", "HTTP status=500")
    )
    return table(spark, sf_dir, "events").select("event_id", X.is_short_html_error(text).alias("is_short"))


@query("d13_formats", f"""
SELECT p_partkey, CASE WHEN p_size <= {len(V.FORMATS)} THEN list_extract({V.FORMATS}, p_size)
  WHEN p_size <= 35 THEN 'CSV XLSX DOCX' ELSE '' END AS formats FROM part""")
def d13_formats(spark, sf_dir):
    size = F.col("p_size")
    one = F.lower(F.get(F.array(*[F.lit(f) for f in V.FORMATS]), size - 1))
    text = (
        F.when(size <= len(V.FORMATS), M.cat(F.col("p_name"), " (", one, ")"))
        .when(size <= 35, "docx, xlsx; Csv csv")
        .otherwise(M.cat("CSV파일 XMLS ", F.col("p_name")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.detect_formats(text), " ").alias("formats"))


@query("d15_d18_card_values", """
SELECT p_partkey, p_brand AS provider, '2024.3.' || p_size AS modified, '' AS registered, CAST(p_partkey * 7 AS VARCHAR) AS views,
  CASE WHEN p_size <= 40 THEN CAST(p_size AS VARCHAR) ELSE '' END AS downloads, p_partkey * 7 AS views_n,
  CAST(CASE WHEN p_size <= 40 THEN p_size ELSE 0 END AS BIGINT) AS downloads_n,
  CASE WHEN p_size > 20 AND p_size <= 30 THEN CAST(p_size AS VARCHAR) ELSE '' END AS piece_downloads FROM part""")
def d15_d18_card_values(spark, sf_dir):
    size, n = F.col("p_size"), M.thousands(F.col("p_partkey") * 7)
    s = size.cast("string")
    counts = (
        F.when(size <= 10, M.cat("조회수 ", n, " 다운로드 ", s))
        .when(size <= 20, M.cat("조회 수: ", n, "  다운로드 수： ", s))
        .when(size <= 30, M.cat("다운로드수 (건) ", s, " / 조회수 : ", n))
        .when(size <= 40, M.cat("조회수 ", n, " 다운로드수 ", s))
        .otherwise(M.cat("조회수", n))
    )
    # The looser integer rule does not know the "(건)" form, so that group is read plainly there.
    loose = F.when((size > 20) & (size <= 30), M.cat("다운로드 ", s, " / 조회 ", n)).otherwise(counts)
    card = M.cat("제공기관 ", F.col("p_brand"), " 수정일: 2024.3.", s, " 조회수 없음")
    texts = table(spark, sf_dir, "part").select("p_partkey", "p_size", counts.alias("t"), loose.alias("u"), card.alias("card"))
    both = texts.select("*", X.card_counts(F.col("t")).alias("c"), X.card_counts_int(F.col("u")).alias("i"))
    piece = F.when((size > 20) & (size <= 30), X.count_after_label(F.col("t"), V.DOWNLOAD_LABELS)).otherwise("")
    return both.select(
        "p_partkey",
        X.labelled_value(F.col("card"), "제공기관").alias("provider"),
        X.labelled_value(F.col("card"), "수정일").alias("modified"),
        X.labelled_value(F.col("card"), "등록일").alias("registered"),
        "c.views",
        "c.downloads",
        F.col("i.views").alias("views_n"),
        F.col("i.downloads").alias("downloads_n"),
        piece.alias("piece_downloads"),
    )


@query("d19_d20_digits", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '없음' ELSE CAST(o_orderkey * 997 AS VARCHAR) END AS digits,
  CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_orderkey * 997 END AS whole, CASE WHEN o_orderstatus = 'O' THEN o_orderkey * 997 ELSE -1 END AS progress FROM orders""")
def d19_d20_digits(spark, sf_dir):
    n, status = M.thousands(F.col("o_orderkey") * 997), F.col("o_orderstatus")
    text = F.when(status == "P", " 없음 ").when(status == "O", n).otherwise(M.cat("약 ", n, " 건 (2)"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", X.only_digits(text).alias("digits"), X.only_int(text).alias("whole"), X.progress_int(text, -1).alias("progress")
    )


@query("d21_date", """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN strftime(o_orderdate + INTERVAL 8 YEAR, '%Y-%m-%d')
  WHEN o_orderpriority = '5-LOW' THEN '수시' ELSE strftime(o_orderdate + INTERVAL 8 YEAR, '%Y%m%d') END AS day FROM orders""")
def d21_date(spark, sf_dir):
    day, kind = F.col("o_orderdate") + F.expr("INTERVAL 8 YEAR"), F.col("o_orderpriority")
    y, m, d = (f(day).cast("string") for f in (F.year, F.month, F.day))
    text = (
        F.when(kind == "1-URGENT", M.cat("등록 ", y, "년 ", m, "월 ", d, "일"))
        .when(kind == "2-HIGH", M.cat(y, ".", m, ". ", d))
        .when(kind == "3-MEDIUM", M.cat(y, "/", m, "/", d, " 10:00"))
        .when(kind == "5-LOW", " 수시")
        .otherwise(F.date_format(day, "yyyyMMdd"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", X.normalize_date(text).alias("day"))


@query("d22_blocked", f"""
WITH p(i, signal) AS (VALUES {', '.join(f"({i}, '{p}')" for i, p in enumerate(V.BLOCK_PHRASES))})
SELECT event_id, CASE event_type WHEN 'error' THEN signal WHEN 'signup' THEN '\\bHTTP\\s*429\\b' WHEN 'click' THEN '\\bStatus\\s*Code\\s*[:=]?\\s*403\\b' ELSE '' END AS signal,
  event_type IN ('error', 'signup', 'click') AS blocked FROM events LEFT JOIN p ON i = event_id % {len(V.BLOCK_PHRASES)}""")
def d22_blocked(spark, sf_dir):
    kind, key = F.col("event_type"), F.col("event_id").cast("string")
    phrase = F.get(F.array(*[F.lit(p) for p in V.BLOCK_PHRASES]), (F.col("event_id") % len(V.BLOCK_PHRASES)).cast("int"))
    text = (
        F.when(kind == "error", M.cat(key, " ", phrase, " HTTP 403"))
        .when(kind == "signup", M.cat("http  429 ", key))
        .when(kind == "click", M.cat("status code = 403 ", key))
        .when(kind == "view", M.cat("접근 제한 구역 현황 429개 403동 ", key))
        .otherwise(M.cat(F.repeat(F.lit("가"), 3000), "captcha"))
    )
    return table(spark, sf_dir, "events").select("event_id", X.block_signal(text).alias("s")).select("event_id", "s.signal", "s.blocked")


LAST4 = "lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')"


@query("d23_d24_phone", f"""
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '053-670-' || {LAST4} WHEN 'MACHINERY' THEN '02-1234-' || {LAST4}
  WHEN 'FURNITURE' THEN '+82-10-1234-' || {LAST4} WHEN 'HOUSEHOLD' THEN '044-***-' || {LAST4} ELSE '1566-0025' END AS phone,
  c_mktsegment = 'AUTOMOBILE' AND c_nationkey < 12 AS is_portal FROM customer""")
def d23_d24_phone(spark, sf_dir):
    last4, seg = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.col("c_mktsegment")
    text = (
        F.when(seg == "BUILDING", M.cat("담당 053-670-", last4, " 내선"))
        .when(seg == "MACHINERY", M.cat("02)1234.", last4))
        .when(seg == "FURNITURE", M.cat("문의 +82-10-1234-", last4))
        .when(seg == "HOUSEHOLD", M.cat("044 - ***-", last4))
        .otherwise(F.when(F.col("c_nationkey") < 12, "대표번호 1566-0025").otherwise("1566-0025"))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", X.phone_number(text).alias("phone"), X.is_portal_phone(text).alias("is_portal"))


@query("d25_tel", """
WITH d AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '1577' WHEN 'MACHINERY' THEN '02777' WHEN 'FURNITURE' THEN '021234'
    WHEN 'HOUSEHOLD' THEN '053123' ELSE '0101234' END || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS s FROM customer)
SELECT c_custkey, CASE length(s) WHEN 8 THEN substr(s, 1, 4) || '-' || substr(s, 5) WHEN 9 THEN substr(s, 1, 2) || '-' || substr(s, 3, 3) || '-' || substr(s, 6)
  WHEN 11 THEN substr(s, 1, 3) || '-' || substr(s, 4, 4) || '-' || substr(s, 8)
  ELSE CASE WHEN s LIKE '02%' THEN substr(s, 1, 2) || '-' || substr(s, 3, 4) || '-' || substr(s, 7)
       ELSE substr(s, 1, 3) || '-' || substr(s, 4, 3) || '-' || substr(s, 7) END END AS tel FROM d""")
def d25_tel(spark, sf_dir):
    last4, seg = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.col("c_mktsegment")
    head = F.when(seg == "BUILDING", "1577").when(seg == "MACHINERY", "02 777").when(seg == "FURNITURE", "02)1234").when(seg == "HOUSEHOLD", "053.123").otherwise("010-1234")
    return table(spark, sf_dir, "customer").select("c_custkey", X.format_tel_no(M.cat(head, "-", last4)).alias("tel"))


@query("d26_org_variants", """
SELECT s_suppkey, unnest(['가 ' || s_name, '가' || s_name, '가 ' || s_name || '㈜', '가 ' || s_name || '(주)', '㈜가 ' || s_name, '(주)가 ' || s_name,
    '가' || s_name || '㈜', '가' || s_name || '(주)', '가 ' || s_name || '(재)', '(재)가 ' || s_name, '가' || s_name || '(재)']) AS org_name,
  unnest(range(11)) AS rank FROM supplier""")
def d26_org_variants(spark, sf_dir):
    names = X.org_variations(M.cat(" 가  ", F.col("s_name")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(names).alias("rank", "org_name")).withColumn("rank", F.col("rank").cast("long"))


@query("d27_d28_d29_display", """
SELECT o_orderkey, CASE WHEN s >= 3600 THEN lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0')
    || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS elapsed,
  CASE WHEN o_orderstatus = 'P' THEN 0 ELSE least(100, greatest(0, o_orderkey - 50)) END AS percent, 'org' || o_custkey || '_주' AS safe_org
FROM (SELECT *, o_orderkey % 90000 AS s FROM orders)""")
def d27_d28_d29_display(spark, sf_dir):
    text = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise((F.col("o_orderkey") - 50).cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        X.fmt_elapsed((F.col("o_orderkey") % 90000).cast("double") + 0.75).alias("elapsed"),
        X.clamp_percent(text).alias("percent"),
        X.safe_org_name(M.cat("org", F.col("o_custkey").cast("string"), "(주)")).alias("safe_org"),
    )
