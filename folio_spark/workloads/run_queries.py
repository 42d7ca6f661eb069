"""Queries over runs: retries, upserts, counters, logs, file names, sinks, streams, whole jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from .. import vocab as V
from ..operators import downloads as W
from ..operators import merge as G
from ..operators import telemetry as T
from ..operators.numbering import number_rows
from ..plans.metadata import collect_details, full_run, org_report, retry_run
from ..session import shared_dir
from ..sources import tables as B
from ..streaming import commits, ingest
from . import markup as M
from .detail_queries import DETAIL_SQL, LINE_KEY, line_key
from .registry import PORTAL, query, stored, table

def scratch(spark, name: str) -> str:
    """A new folder under the shared folder, for queries that write and read back."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- fail log -------------------------------------------------------------------------------------
FAIL_LOG_SQL = """
WITH fail_log AS (SELECT event_id AS line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS collected_at, 'fetch_detail_httpx' AS stage, 'u' || user_id AS dataset_name,
  CASE WHEN value < 2 THEN NULL WHEN value < 10 THEN 'n/a' WHEN value < 20 THEN 'https://portal.example/list?u=' || user_id
    ELSE 'https://portal.example/data/' || user_id || '/fileData.do' END AS url,
  CASE WHEN value < 60 THEN CAST(event_id AS VARCHAR) ELSE '' END AS seq, CAST(user_id AS VARCHAR) AS views, '3' AS downloads, event_type AS error
FROM events WHERE event_type = 'error')
"""


def event_fail_log(spark, sf_dir) -> DataFrame:
    user, value = F.col("user_id").cast("string"), F.col("value")
    url = (
        F.when(value < 10, F.when(value >= 2, "n/a"))
        .when(value < 20, M.cat(PORTAL + "/list?u=", user))
        .otherwise(M.cat(" " + PORTAL + "/data/", user, "/fileData.do"))
    )
    return table(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.col("event_id").alias("line_no"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("collected_at"),
        F.lit("fetch_detail_httpx").alias("stage"),
        M.cat("u", user).alias("dataset_name"),
        url.alias("url"),
        F.when(value < 60, F.col("event_id").cast("string")).otherwise("").alias("seq"),
        user.alias("views"),
        F.lit("3").alias("downloads"),
        F.col("event_type").alias("error"),
        F.lit("").alias("traceback"),
    )


@query("c17_retry", FAIL_LOG_SQL + """
, k AS (SELECT * FROM fail_log WHERE url LIKE '%/data/%' QUALIFY row_number() OVER (PARTITION BY url ORDER BY line_no DESC) = 1)
SELECT coalesce(TRY_CAST(nullif(seq, '') AS BIGINT), row_number() OVER (ORDER BY line_no)) AS seq, dataset_name AS title, views, downloads, url AS detail_url,
  error AS first_error FROM k""")
def c17_retry(spark, sf_dir):
    return G.retry_items(event_fail_log(spark, sf_dir)).select("seq", "title", "views", "downloads", "detail_url", "first_error")


@query("c18_exists", FAIL_LOG_SQL + "SELECT count(DISTINCT url) FILTER (url LIKE 'http%') AS targets FROM fail_log")
def c18_exists(spark, sf_dir):
    return G.retry_target_count(event_fail_log(spark, sf_dir))


@query("c19_cooldown", """
SELECT CAST(greatest(0.0, 180.0 - (epoch_us(TIMESTAMP '2024-01-30 23:24:00') - epoch_us(date_trunc('second', max(ts)))) / 1000000) AS DOUBLE) AS remain_seconds
FROM events WHERE event_type = 'error'""")
def c19_cooldown(spark, sf_dir):
    return G.retry_wait(event_fail_log(spark, sf_dir), F.lit("2024-01-30 23:24:00").cast("timestamp"))


# --- upserts --------------------------------------------------------------------------------------------
def order_metadata(spark, sf_dir) -> DataFrame:
    """A previous run: one row per order, addresses of status P missing."""
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("line_no"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("seq"),
        M.cat("old ", key).alias("dataset_name"),
        F.when(F.col("o_orderstatus") != "P", M.cat("u", F.col("o_custkey").cast("string"), "-", F.col("o_orderpriority"))).alias("detail_url"),
    )


def urgent_retries(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus <> 'P'")
    return orders.select(
        F.col("o_orderkey").alias("line_no"), F.col("o_custkey").alias("seq"), M.cat("new ", F.col("o_orderkey").cast("string")).alias("dataset_name"),
        M.cat("u", F.col("o_custkey").cast("string"), "-1-URGENT").alias("detail_url"),
    )


UPSERT_SQL = """
WITH b AS (SELECT 0 AS src, o_orderkey AS line_no, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS seq, 'old ' || o_orderkey AS dataset_name,
    CASE WHEN o_orderstatus <> 'P' THEN 'u' || o_custkey || '-' || o_orderpriority END AS detail_url FROM orders
  UNION ALL SELECT 1, o_orderkey, o_custkey, 'new ' || o_orderkey, 'u' || o_custkey || '-1-URGENT' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P'),
k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY detail_url ORDER BY src DESC, line_no DESC) = 1)
"""


@query("c20_upsert", UPSERT_SQL + "SELECT seq, dataset_name, detail_url FROM k")
def c20_upsert(spark, sf_dir):
    return G.upserted(order_metadata(spark, sf_dir), urgent_retries(spark, sf_dir)).select("seq", "dataset_name", "detail_url")


@query("c30_sort", UPSERT_SQL + """
SELECT row_number() OVER (ORDER BY seq NULLS LAST, src, line_no) AS place, detail_url FROM k""")
def c30_sort(spark, sf_dir):
    rows = G.upsert_metadata(order_metadata(spark, sf_dir), urgent_retries(spark, sf_dir))
    last = rows.withColumn("_late", F.col("seq").isNull())
    return G.number_rows(last, ["_late", "seq", "_src", "line_no"], "place").select("place", "detail_url")


@query("c21_failrecon", """
WITH old AS (SELECT event_id AS line_no, event_type AS stage, CASE WHEN value >= 3 THEN 'u' || user_id || '-' || event_type END AS url FROM events),
ok AS (SELECT 'u' || c_custkey || '-view' AS url FROM customer), again AS (SELECT c_custkey AS line_no, 'again' AS stage, 'u' || c_custkey || '-click' AS url FROM customer),
b AS (SELECT 0 AS src, * FROM old WHERE url IS NULL OR url NOT IN (SELECT url FROM ok UNION ALL SELECT url FROM again) UNION ALL SELECT 1, * FROM again)
SELECT line_no, stage, url FROM b QUALIFY row_number() OVER (PARTITION BY url ORDER BY src DESC, line_no DESC) = 1""")
def c21_failrecon(spark, sf_dir):
    events, customer = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer")
    user, key = F.col("user_id").cast("string"), F.col("c_custkey").cast("string")
    old = events.select(
        F.col("event_id").alias("line_no"), F.col("event_type").alias("stage"),
        F.when(F.col("value") >= 3, M.cat("u", user, "-", F.col("event_type"))).alias("url"),
    )
    ok = customer.select(M.cat("u", key, "-view").alias("detail_url"))
    again = customer.select(F.col("c_custkey").alias("line_no"), F.lit("again").alias("stage"), M.cat("u", key, "-click").alias("url"))
    return G.reconcile_fails(old, ok, again)


@query("c22_align", "SELECT " + ", ".join(
    {"seq": "CAST(o_custkey AS VARCHAR)", "url": "'u' || o_orderkey", "stage": "o_orderstatus"}.get(n, "CAST(NULL AS VARCHAR)") + f" AS {n}" for n, _ in V.FAIL_FIELDS) + " FROM orders")
def c22_align(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("stage"), F.col("o_custkey").alias("seq"), F.lit("x").alias("dropped"), M.cat("u", F.col("o_orderkey").cast("string")).alias("url")
    )
    return B.align(raw, S.FAILS)


@query("c23_project", "SELECT 'old ' || o_orderkey AS dataset_name, CASE WHEN o_orderstatus <> 'P' THEN 'u' || o_custkey || '-' || o_orderpriority END AS detail_url FROM orders")
def c23_project(spark, sf_dir):
    return B.project(order_metadata(spark, sf_dir), ["dataset_name", "nothing", "detail_url"])


# --- file names ---------------------------------------------------------------------------------------
@query("c25_unique", """
WITH f AS (SELECT p_brand AS dir, p_name || '.csv' AS name, p_partkey AS ord FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY dir, name ORDER BY ord) - 1 AS n FROM f)
SELECT dir, name, ord, CASE WHEN n = 0 THEN name ELSE regexp_replace(name, '\\.csv$', '') || '(' || n || ').csv' END AS final_name FROM k""")
def c25_unique(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dir"), M.cat(F.col("p_name"), ".csv").alias("name"), F.col("p_partkey").alias("ord"))
    return W.unique_names(files)


@query("c26_history", """
SELECT l_orderkey, l_linenumber AS link_no, 'order_' || l_orderkey || CASE WHEN l_returnflag = 'A' THEN '' ELSE '/과거데이터' END AS dir,
  'p_' || l_partkey || CASE WHEN l_returnflag = 'A' THEN '' ELSE '(과거' || l_linenumber || ')' END || CASE WHEN l_linestatus = 'O' THEN '.csv' ELSE '' END AS name
FROM lineitem""")
def c26_history(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("link_no"), M.cat("order/", F.col("l_orderkey").cast("string")).alias("dataset_title"),
        M.cat("p:", F.col("l_partkey").cast("string"), F.when(F.col("l_linestatus") == "O", ".csv").otherwise("")).alias("suggested_name"),
        (F.col("l_returnflag") != "A").alias("is_history"),
    )
    return W.manifest(links).select("l_orderkey", F.col("link_no").cast("int").alias("link_no"), "dir", "name")


# --- counters and logs --------------------------------------------------------------------------------------
@query("c27_summary", """
SELECT count(*) FILTER (o_orderstatus <> 'P') + (SELECT count(*) FROM events WHERE event_type = 'error') AS processed, count(*) FILTER (o_orderstatus <> 'P') AS ok_rows,
  (SELECT count(*) FROM lineitem) AS column_rows, (SELECT count(*) FROM events WHERE event_type = 'error') AS fail_rows,
  CAST((count(*) FILTER (o_orderstatus <> 'P') + (SELECT count(*) FROM events WHERE event_type = 'error')) / 8.0 AS DOUBLE) AS rate FROM orders""")
def c27_summary(spark, sf_dir):
    ok = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    fails = table(spark, sf_dir, "events").where("event_type = 'error'")
    return G.run_summary(ok, table(spark, sf_dir, "lineitem"), fails, F.lit(8.0))


@query("c28_counters", """
WITH e AS (SELECT event_type IN ('view', 'click') AS ok, event_type = 'error' AS bad, event_type IN ('signup', 'purchase') AS held, * FROM events),
c AS (SELECT user_id AS job_id, ts, event_id, sum(CAST(ok AS BIGINT)) OVER w AS n_ok, sum(CAST(bad AS BIGINT)) OVER w AS n_bad, sum(CAST(held AS BIGINT)) OVER w AS n_held
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT job_id, ts, event_id, CAST(n_ok AS BIGINT) AS n_ok, CAST(n_bad + n_held AS BIGINT) AS n_fail_shown, CAST(n_held AS BIGINT) AS n_deferred,
  CAST(n_ok + n_bad + n_held AS BIGINT) AS done, CAST((n_ok + n_bad + n_held) * 100 AS DOUBLE) / 500 AS percent FROM c""")
def c28_counters(spark, sf_dir):
    kind = F.col("event_type")
    outcome = F.when(kind.isin("view", "click"), "ok").when(kind == "error", "fail").otherwise("deferred")
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), "ts", "event_id", outcome.alias("outcome"), F.lit(500).alias("total")
    )
    return T.outcome_counters(events, ["ts", "event_id"])


@query("c29_blocks", """
WITH k AS (SELECT user_id AS job_id, ts, event_id AS signal_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'signup')
SELECT job_id, ts, signal_id, n AS n_signals, CAST(least(12, 4 * least(n, 3)) AS BIGINT) AS cooldown,
  CAST(epoch_us(ts) / 1000000 + least(12, 4 * least(n, 3)) AS DOUBLE) AS cooldown_until FROM k""")
def c29_blocks(spark, sf_dir):
    signals = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("signal_id"))
    return T.block_cooldowns(signals, enabled=True)


def log_lines(events: DataFrame) -> DataFrame:
    """Crawl log lines: one job per user, one line per event."""
    kind, n = F.col("event_type"), F.floor("value").cast("long")
    line = (
        F.when(kind == "view", M.cat("[LIST] page ", F.lpad(n.cast("string"), 3, "0"), "/500 수집 중"))
        .when(kind == "click", M.cat("[LIST] page 01 +", n.cast("string"), "건 | 누적 ", M.thousands(n * 100), "/40,000"))
        .when(kind == "signup", M.cat("[⭐️DETAIL]    ", n.cast("string"), "/500   (  5.5%) | 성공 ", n.cast("string"), " | 실패 0"))
        .when((kind == "purchase") & (F.col("value") < 20), "[후순위 처리] 보류 URL 3건")
        .when(kind == "purchase", "잡음")
        .when(F.col("value") < 20, "[상세 URL 수집 완료] 913건")
        .otherwise("[전체 완료]")
    )
    return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("line_no"), line.alias("line"))


# Percent as a fold over each job's lines: "set" puts the value, "floor" raises to it, "held" raises and caps at 30.
E3_SQL = """
WITH RECURSIVE s AS (SELECT user_id AS job_id, event_id AS line_no, value, CAST(floor(value) AS BIGINT) AS n, event_type,
    CASE event_type WHEN 'view' THEN 'list' WHEN 'click' THEN 'list_page' WHEN 'signup' THEN 'detail' WHEN 'purchase' THEN 'recovery'
      ELSE CASE WHEN value < 20 THEN 'urls_done' ELSE 'finish' END END AS event,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE NOT (event_type = 'purchase' AND value >= 20)),
v AS (SELECT *, CASE event WHEN 'list' THEN 5 + CAST(floor(least(1.0, n / 500) * 25) AS BIGINT) WHEN 'list_page' THEN 10
    WHEN 'detail' THEN 30 + CAST(floor(least(1.0, n / 500) * 65) AS BIGINT) WHEN 'recovery' THEN 95 WHEN 'urls_done' THEN 30 ELSE 96 END AS val FROM s),
r AS (SELECT *, CASE event WHEN 'list_page' THEN least(30, greatest(0, val)) ELSE val END AS percent FROM v WHERE i = 1
  UNION ALL SELECT v.*, CASE v.event WHEN 'list_page' THEN least(30, greatest(r.percent, v.val)) WHEN 'recovery' THEN greatest(r.percent, v.val)
    WHEN 'finish' THEN greatest(r.percent, v.val) ELSE v.val END FROM r JOIN v ON v.job_id = r.job_id AND v.i = r.i + 1)
SELECT job_id, line_no, event, CASE event WHEN 'list' THEN n WHEN 'list_page' THEN n * 100 WHEN 'detail' THEN n END AS done,
  CAST(CASE event WHEN 'list' THEN 500 WHEN 'list_page' THEN 40000 WHEN 'detail' THEN 500 WHEN 'urls_done' THEN 913 END AS BIGINT) AS total,
  CASE WHEN event = 'detail' THEN n END AS ok, CAST(CASE WHEN event = 'detail' THEN 0 END AS BIGINT) AS fail, CAST(percent AS BIGINT) AS percent FROM r"""


@query("e3_progress", E3_SQL)
def e3_progress(spark, sf_dir):
    return T.progress_events(log_lines(table(spark, sf_dir, "events")))


@query("e3_messages", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'set' WHEN 'click' THEN 'set' WHEN 'signup' THEN 'floor' WHEN 'error' THEN 'floor' END AS kind,
  CAST(CASE event_type WHEN 'view' THEN 30 WHEN 'click' THEN 98 WHEN 'signup' THEN 10 WHEN 'error' THEN 30 END AS BIGINT) AS val FROM events""")
def e3_messages(spark, sf_dir):
    kind, key = F.col("event_type"), F.col("event_id").cast("string")
    msg = (
        F.when(kind == "view", M.cat("상세 URL ", M.thousands(F.col("event_id")), "건 수집 완료"))
        .when(kind == "click", M.cat("엑셀 ", key))
        .when(kind == "signup", M.cat("상세 URL 수집 중 ", key))
        .when(kind == "error", M.cat("메타데이터 ", key))
        .otherwise(key)
    )
    return table(spark, sf_dir, "events").select("event_id", T.message_steps(msg).alias("s")).select("event_id", "s.kind", "s.val")


@query("e4_percent", """
WITH e AS (SELECT event_id, event_type, CAST(floor(value) AS BIGINT) AS n, value FROM events)
SELECT event_id, CAST(CASE WHEN value > 150 THEN least(100, n) WHEN event_type = 'view' THEN CASE WHEN value < 10 THEN 10 ELSE 5 + least(25, CAST(floor(n / 100 * 25) AS BIGINT)) END
  WHEN event_type = 'click' THEN least(100, 30 + CAST(floor(n / 100 * 60) AS BIGINT)) WHEN event_type = 'signup' THEN 95 WHEN event_type = 'purchase' THEN 30 ELSE 5 END AS BIGINT) AS percent FROM e""")
def e4_percent(spark, sf_dir):
    kind, n = F.col("event_type"), F.floor("value")
    stage = F.when(kind == "view", "list").when(kind == "click", "detail").when(kind == "signup", "save").when(kind == "purchase", "list_done").otherwise("odd")
    percent = T.payload_percent(stage, F.when(F.col("value") > 150, n), n, F.when(F.col("value") >= 10, 100), n, F.lit(100))
    return table(spark, sf_dir, "events").select("event_id", percent.alias("percent"))


@query("e5_download_log", """
WITH e AS (SELECT user_id AS job_id, event_id AS line_no, CAST(floor(value) AS BIGINT) AS n, CASE event_type WHEN 'view' THEN 'page' WHEN 'click' THEN 'item' WHEN 'signup' THEN 'current_saved'
    WHEN 'purchase' THEN 'past_saved' ELSE CASE WHEN value < 20 THEN 'targets' WHEN value < 40 THEN 'failed' ELSE 'other' END END AS kind FROM events),
c AS (SELECT *, CAST(sum(CASE WHEN kind = 'current_saved' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS current_saved, CAST(sum(CASE WHEN kind = 'past_saved' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS past_saved,
    CAST(sum(CASE WHEN kind = 'failed' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS failed,
    coalesce(last_value(CASE WHEN kind = 'item' THEN n END IGNORE NULLS) OVER w, 0) AS current,
    coalesce(last_value(CASE WHEN kind = 'item' THEN 500 WHEN kind = 'targets' THEN 1000 + n END IGNORE NULLS) OVER w, 0) AS total
  FROM e WINDOW w AS (PARTITION BY job_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT job_id, line_no, kind, current_saved, past_saved, failed, current, total, CAST(CASE kind WHEN 'page' THEN 5 + least(25, CAST(floor(n / 100 * 25) AS BIGINT)) WHEN 'targets' THEN 30
  WHEN 'other' THEN 5 ELSE 30 + CAST(floor(current / greatest(total, 1) * 60) AS BIGINT) END AS BIGINT) AS percent FROM c""")
def e5_download_log(spark, sf_dir):
    kind, value, n = F.col("event_type"), F.col("value"), F.floor("value").cast("string")
    line = (
        F.when(kind == "view", M.cat("📄 파일데이터 목록 ", n, "페이지 수집 중"))
        .when(kind == "click", M.cat("📂 [", n, "/500] 이름"))
        .when(kind == "signup", M.cat("   ✅ 현재데이터 저장 → a", n, ".csv"))
        .when(kind == "purchase", "   ✅ 과거데이터[3] 저장 → b.csv")
        .when(value < 20, M.cat("📑 다운로드 대상 데이터셋 ", M.thousands(F.floor("value") + 1000), "건 수집 완료"))
        .when(value < 40, "   ⚠ 현재데이터 실패: x")
        .otherwise("🔗 https://x")
    )
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("line_no"), line.alias("line"))
    return T.download_events(log, 100)


@query("e5_counts_log", """
SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 5 + least(90, CAST(floor(floor(value) / 100 * 90) AS BIGINT)) WHEN 'click' THEN 100 ELSE 5 END AS BIGINT) AS percent FROM events""")
def e5_counts_log(spark, sf_dir):
    n = F.floor("value").cast("string")
    line = F.when(F.col("event_type") == "view", M.cat("✅ ", n, "페이지 완료: 신규 3건")).when(F.col("event_type") == "click", M.cat("✅ 수집 완료: 총 ", n, "건")).otherwise("📌 종료")
    return table(spark, sf_dir, "events").select("event_id", T.counts_percent(line, 100).alias("percent"))


# --- sinks -----------------------------------------------------------------------------------------------------
@query("a11_a12_chunks", f"""
WITH k AS (SELECT {LINE_KEY} AS k, row_number() OVER (ORDER BY {LINE_KEY}) AS rn FROM lineitem)
SELECT k, (rn - 1) // 1000 AS chunk_no, '메타_데이터_' || lpad(CAST((rn - 1) // 1000 + 1 AS VARCHAR), 3, '0') AS chunk_name FROM k""")
def a11_a12_chunks(spark, sf_dir):
    return B.chunks(table(spark, sf_dir, "lineitem").select(line_key().alias("k")), ["k"], "메타/데이터", cap=1000)


@query("a8_metadata_sink", """
SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS "최종순번", 'old ' || o_orderkey AS "파일데이터명",
  CASE WHEN o_orderstatus <> 'P' THEN 'u' || o_custkey || '-' || o_orderpriority END AS "상세페이지 URL", CAST(NULL AS VARCHAR) AS "수집파일" FROM orders""")
def a8_metadata_sink(spark, sf_dir):
    path = scratch(spark, "metadata")
    B.save_metadata(order_metadata(spark, sf_dir), path, arrival=("line_no",))
    return spark.read.parquet(path).select("최종순번", "파일데이터명", "상세페이지 URL", "수집파일")


@query("a3_a9_fail_log_csv", FAIL_LOG_SQL + """
SELECT line_no, collected_at, stage, dataset_name, coalesce(url, '') AS url, seq, views, downloads, error FROM fail_log""")
def a3_a9_fail_log_csv(spark, sf_dir):
    path = scratch(spark, "fails")
    B.save_fails(event_fail_log(spark, sf_dir), path, fmt="csv")
    back = B.fail_log(spark, path, "csv").na.fill("")
    return back.select("line_no", "collected_at", "stage", "dataset_name", F.trim("url").alias("url"), "seq", "views", "downloads", "error")


@query("a3_a9_fail_log_parquet", FAIL_LOG_SQL + "SELECT * FROM fail_log")
def a3_a9_fail_log_parquet(spark, sf_dir):
    path = scratch(spark, "fails")
    B.save_fails(event_fail_log(spark, sf_dir), path)
    return B.fail_log(spark, path).withColumn("url", F.trim("url")).drop("traceback")


@query("a1_listing_source", """
WITH l AS (SELECT p_brand AS org, p_partkey // 100 + 1 AS page_no FROM part UNION ALL SELECT p_brand, p_partkey // 100 + 2 FROM part WHERE p_size > 40)
SELECT org, count(DISTINCT page_no) AS pages, max(page_no) AS last_page FROM l GROUP BY 1""")
def a1_listing_source(spark, sf_dir):
    path = scratch(spark, "listing")
    M.part_listing(spark, sf_dir).write.partitionBy("org").parquet(path)
    pages = B.listing_pages(spark, path)
    return pages.groupBy("org").agg(F.count("*").alias("pages"), F.max("page_no").cast("long").alias("last_page"))


@query("a2_detail_source", """
SELECT url, CAST(200 AS BIGINT) AS status, length(html) AS chars, md5(html) AS digest FROM pages""")
def a2_detail_source(spark, sf_dir):
    path = scratch(spark, "detail")
    table(spark, sf_dir, "pages").select("url", F.lit(200).alias("status"), "html").write.parquet(path)
    pages = B.detail_pages(spark, path)
    return pages.select("url", F.col("status").cast("long").alias("status"), F.length("html").cast("long").alias("chars"), F.md5("html").alias("digest"))


@query("a4_previous_metadata", """
SELECT 'stored' AS kind, count(*) AS n, count(DISTINCT o_custkey) FILTER (o_orderpriority <> '5-LOW') AS seqs, count(*) AS names FROM orders
UNION ALL SELECT 'missing', 0, 0, 0""")
def a4_previous_metadata(spark, sf_dir):
    path = scratch(spark, "previous")
    B.save_metadata(order_metadata(spark, sf_dir), path, arrival=("line_no",))
    runs = {"stored": B.previous_metadata(spark, path), "missing": B.previous_metadata(spark, path + "-none")}
    counted = [r.agg(F.lit(k).alias("kind"), F.count("*").alias("n"), F.countDistinct("seq").alias("seqs"), F.count("dataset_name").alias("names")) for k, r in runs.items()]
    return counted[0].unionByName(counted[1])


@query("a10_counts_sink", """SELECT p_name AS "데이터명", p_partkey * 7 AS "조회수", CAST(p_size AS BIGINT) AS "다운로드수", 'u' || p_partkey AS "상세페이지 URL" FROM part""")
def a10_counts_sink(spark, sf_dir):
    path = scratch(spark, "counts")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("title"), (F.col("p_partkey") * 7).alias("views"), F.col("p_size").alias("downloads"), M.cat("u", F.col("p_partkey").cast("string")).alias("detail_url")
    )
    B.save_counts(rows, path)
    return spark.read.parquet(path)


# --- whole jobs --------------------------------------------------------------------------------------------------
def order_listing(spark, sf_dir, per_page: int) -> DataFrame:
    """Five organisations' listings of all orders, full pages of ``per_page`` cards.

    A page of one organisation, nine tenths down its list, is missing, which ends its walk there.
    """
    ranked = number_rows(M.order_facts(spark, sf_dir), ["o_orderkey"], "_n", within=["c_mktsegment"])
    page = F.floor((F.col("_n") - 1) / per_page).cast("int") + 1
    li = M.card(F.col("o_orderkey"), F.col("c_name"), F.col("c_mktsegment"), F.col("o_orderstatus"), F.day("o_orderdate"))
    rows = ranked.select(F.col("c_mktsegment").alias("org"), page.alias("page_no"), F.struct("o_orderkey", li.alias("li")).alias("c"))
    last = rows.groupBy("org").agg(F.max("page_no").alias("_last"))
    rows = rows.join(last, "org").where((F.col("org") != "MACHINERY") | (F.col("page_no") != F.greatest(F.floor(F.col("_last") * 9 / 10), F.lit(1)) + 1)).drop("_last")
    pages = rows.groupBy("org", "page_no").agg(F.array_sort(F.collect_list("c")).alias("cs"), F.count("*").alias("n"))
    return stored(pages, "page_no").select(
        "org", "page_no", F.lit(PORTAL + "/list").alias("list_url"), F.lit(200).alias("status"),
        M.listing_page(F.transform("cs", lambda c: c["li"]), F.col("n")).alias("html"),
    )


def run_sql(per_page: int) -> str:
    return DETAIL_SQL + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY c_mktsegment) AS listed FROM f),
reached AS (SELECT * FROM ranked WHERE c_mktsegment <> 'MACHINERY' OR (n - 1) // {per_page} < greatest(((listed - 1) // {per_page} + 1) * 9 // 10, 1))
"""


RUN_ROWS = """
, run AS (SELECT m.* REPLACE (r.n AS seq, r.c_mktsegment AS provider, r.o_orderstatus AS category, '' AS formats, CAST(r.o_orderkey * 7 AS VARCHAR) AS views,
  CAST(day(r.o_orderdate) AS VARCHAR) AS downloads, '2024-03-' || lpad(CAST(day(r.o_orderdate) AS VARCHAR), 2, '0') AS modified), r.o_orderkey AS k, m.data_limit <> '' AS bad
  FROM reached r JOIN metadata m ON m.seq = r.o_orderkey + 1)
"""


def run_of_orders(spark, sf_dir):
    return full_run(order_listing(spark, sf_dir, 50), M.order_pages(spark, sf_dir).drop("o_orderkey"), PORTAL, "2024-01-01 00:00:00")


@query("metadata_run", run_sql(50) + RUN_ROWS + "SELECT * EXCLUDE (k, bad) FROM run")
def metadata_run(spark, sf_dir):
    return run_of_orders(spark, sf_dir).metadata


@query("metadata_run_columns", run_sql(50) + RUN_ROWS + """
SELECT run.dataset_name, CASE WHEN l.name IS NULL THEN '' ELSE detail_url END AS detail_url, coalesce(CAST(l.seq AS VARCHAR), '') AS seq_in_page,
  coalesce(l.name, '') AS name, coalesce(l.descr, '') AS descr, coalesce(l.dtype, '') AS dtype, coalesce(l.length, '') AS length
FROM run LEFT JOIN l ON l_orderkey = k AND NOT bad""")
def metadata_run_columns(spark, sf_dir):
    """Column rows of the same run; an item without any has one row with its name."""
    return run_of_orders(spark, sf_dir).columns


@query("org_report", run_sql(1000) + """
SELECT m.dataset_name, m.dept_phone, m.detail_url FROM reached r JOIN metadata m ON m.seq = r.o_orderkey + 1""")
def org_report_query(spark, sf_dir):
    facts = M.order_facts(spark, sf_dir)
    counts = facts.groupBy(F.col("c_mktsegment").alias("org_name")).agg(F.count("*").alias("total_count"))
    names = facts.select(M.cat(" ", F.col("c_mktsegment")).alias("user_input")).distinct()
    pages = M.order_pages(spark, sf_dir).drop("o_orderkey")
    report, _ = org_report(names, counts, order_listing(spark, sf_dir, 1000), pages, PORTAL, "2024-01-01 00:00:00", ["dataset_name", "dept_phone", "detail_url"])
    return report


def retry_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fail log, previous metadata and detail pages of a retry; some previous addresses occur twice."""
    orders = table(spark, sf_dir, "orders")
    key, level = F.col("o_orderkey"), F.col("o_orderpriority")
    log = orders.where(level.isin("1-URGENT", "2-HIGH", "3-MEDIUM")).select(
        key.alias("line_no"), F.lit("2024-01-01 00:00:00").alias("collected_at"), F.lit("first").alias("stage"), M.cat("again ", key.cast("string")).alias("dataset_name"),
        F.when(level == "1-URGENT", M.order_url(key)).when(level == "2-HIGH", M.order_url(key + 1_000_000_000)).otherwise(M.cat("n/a ", key.cast("string"))).alias("url"),
        F.lit("").alias("seq"), F.lit("").alias("views"), F.lit("").alias("downloads"), F.lit("x").alias("error"), F.lit("").alias("traceback"),
    )
    # Titles of the error screens and of real pages alike give way to the logged name here.
    pages = M.order_pages(spark, sf_dir).drop("o_orderkey").withColumn("html", F.regexp_replace("html", "(?s)<h1>.*?</h1>", ""))
    def stored_rows(rows: DataFrame, name: str, offset: int) -> DataFrame:
        return rows.select((key + offset).alias("seq"), M.cat(name, key.cast("string")).alias("dataset_name"), M.order_url(key).alias("detail_url"), F.lit("").alias("source_label"))

    previous, twice = stored_rows(orders, "old ", 0), stored_rows(orders.where(level == "5-LOW"), "older ", 1_000_000_000)
    return log, B.align(previous.unionByName(twice), S.METADATA), pages


def retried(metadata: DataFrame, fails: DataFrame) -> DataFrame:
    return metadata.select(F.lit("metadata").alias("kind"), F.col("detail_url").alias("url"), F.col("dataset_name").alias("name"), F.col("source_label").alias("source")).unionByName(
        fails.select(F.lit("fail").alias("kind"), "url", F.col("dataset_name").alias("name"), F.col("stage").alias("source"))
    )


RETRY_SQL = """
SELECT 'metadata' AS kind, 'https://portal.example/data/' || o_orderkey || '/fileData.do' AS url,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'again ' WHEN '5-LOW' THEN 'older ' ELSE 'old ' END || o_orderkey AS name,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '실패로그_재수집' ELSE '' END AS source FROM orders
UNION ALL SELECT 'fail', 'https://portal.example/data/' || (o_orderkey + 1000000000) || '/fileData.do', 'again ' || o_orderkey, 'retry_failed_playwright'
  FROM orders WHERE o_orderpriority = '2-HIGH'
UNION ALL SELECT 'fail', 'n/a ' || o_orderkey, 'again ' || o_orderkey, 'first' FROM orders WHERE o_orderpriority = '3-MEDIUM'"""


@query("retry_run", RETRY_SQL)
def retry_run_query(spark, sf_dir):
    log, previous, pages = retry_inputs(spark, sf_dir)
    run = retry_run(log, previous, pages, PORTAL, "2024-01-02 00:00:00")
    return retried(run.metadata, run.fails)


@query("e6_stored_retry", RETRY_SQL)
def e6_stored_retry(spark, sf_dir):
    """The retry from stored tables, its own tables stored and read again."""
    log, previous, pages = retry_inputs(spark, sf_dir)
    at = {name: scratch(spark, name) for name in ("fails", "metadata", "fails-after", "metadata-after")}
    B.save_fails(log, at["fails"], fmt="csv")
    B.save_metadata(previous, at["metadata"])
    run = retry_run(B.fail_log(spark, at["fails"], "csv"), B.previous_metadata(spark, at["metadata"]), pages, PORTAL, "2024-01-02 00:00:00")
    B.save_metadata(run.metadata, at["metadata-after"])
    B.save_fails(run.fails, at["fails-after"])
    return retried(B.previous_metadata(spark, at["metadata-after"]), B.fail_log(spark, at["fails-after"]))


@query("full_run_fails", """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 9 AS c FROM orders)
SELECT k + 1 AS seq, CASE c WHEN 0 THEN 'deferred_saved_only' WHEN 1 THEN 'fetch_detail_httpx' WHEN 2 THEN 'deferred_saved_only' WHEN 3 THEN 'playwright_fallback_failed'
  WHEN 4 THEN 'fetch_detail_httpx' WHEN 5 THEN 'empty_url' ELSE 'metadata' END AS stage,
  CASE WHEN c = 5 THEN '' ELSE 'https://portal.example/data/' || k || '/fileData.do' END AS url FROM o""")
def full_run_fails(spark, sf_dir):
    """Items answered 429, 503, with a block text, too short, never, and without an address: each
    item comes out once, as metadata or under the stage that decided it."""
    key = F.col("o_orderkey")
    case = key % 9
    listed = table(spark, sf_dir, "orders").select(
        (key + 1).alias("seq"), F.lit("t").alias("raw_title"), F.lit("t").alias("title"), *[F.lit("").alias(c) for c in ("title_source", "formats", "views", "downloads")],
        F.when(case == 5, "").otherwise(M.order_url(key)).alias("detail_url"), F.lit("").alias("source_list_url"), *[F.lit(None).cast("string").alias(c) for c in V.CARD_TARGETS],
    )
    long = F.lit("<p>" + "내용 " * 300 + "</p>")
    pages = stored(table(spark, sf_dir, "orders"), "o_orderkey").where(case != 4).select(
        M.order_url(key).alias("url"), F.when(case == 0, 429).when(case == 1, 503).otherwise(200).alias("status"),
        M.cat("<html><body><h1>t</h1>", F.when(case == 2, M.cat("<p>Too Many Requests</p>", long)).when(case == 3, "").otherwise(long), "</body></html>").alias("html"),
    )
    run = collect_details(listed, pages, PORTAL, "2024-01-01 00:00:00")
    done = run.metadata.select("seq", F.lit("metadata").alias("stage"), F.col("detail_url").alias("url"))
    return done.unionByName(run.fails.select(F.col("seq").cast("long").alias("seq"), "stage", "url"))


# --- streams ---------------------------------------------------------------------------------------------------------
@query("e1_ingest", """
SELECT page_id AS seq, url AS detail_url, 'p' || page_id AS dataset_name, '0' AS views, '실시간수집' AS source_label FROM pages""")
def e1_ingest(spark, sf_dir):
    source = table(spark, sf_dir, "pages")
    raw = ingest.page_stream(spark, f"{sf_dir}/pages*.parquet", source.schema)
    arriving = raw.select("url", F.lit(200).alias("status"), "html")
    null = F.lit(None).cast("string")
    items = source.select(
        F.col("page_id").alias("seq"), M.cat("p", F.col("page_id").cast("string")).alias("raw_title"), M.cat("p", F.col("page_id").cast("string")).alias("title"),
        F.lit("anchor").alias("title_source"), F.lit("").alias("formats"), F.lit("0").alias("views"), F.lit("").alias("downloads"), F.col("url").alias("detail_url"),
        F.lit("").alias("source_list_url"), *[null.alias(c) for c in V.CARD_TARGETS],
    )
    out = scratch(spark, "ingest")
    ingest.ingest_details(arriving, items, PORTAL, f"{out}/rows", f"{out}/state").awaitTermination()
    return ingest.current_metadata(spark, f"{out}/rows").select("seq", "detail_url", "dataset_name", "views", "source_label")


@query("e1_three_tables", DETAIL_SQL + """,
m AS (SELECT seq - 1 AS k, dataset_name, column_list, detail_url, data_limit <> '' AS bad, (seq - 1) % 7 = 0 AND (seq - 1) % 14 <> 0 AS lost FROM metadata)
SELECT 'metadata' AS kind, detail_url AS url, dataset_name AS name, column_list AS detail FROM m WHERE NOT lost
UNION ALL SELECT 'columns', CASE WHEN l.name IS NULL THEN '' ELSE detail_url END, dataset_name, coalesce(l.seq || ' ' || l.name || ' ' || l.descr || ' ' || l.dtype || ' ' || l.length, '    ')
  FROM m LEFT JOIN l ON l_orderkey = k AND NOT bad WHERE NOT lost
UNION ALL SELECT 'fail', detail_url, CASE WHEN k % 3 = 0 THEN 'deferred_saved_only' ELSE 'fetch_detail_httpx' END,
  'HTTP status=' || CASE WHEN k % 3 = 0 THEN '429' ELSE '503' END || ', url=' || detail_url FROM m WHERE lost""")
def e1_three_tables(spark, sf_dir):
    """Every seventh page comes as an error first, every fourteenth again as it should; a batch
    that died before its commit, a replayed batch and a compaction leave the tables as they are."""
    pages = M.order_pages(spark, sf_dir)
    key = F.col("o_orderkey")
    bad = F.when(key % 7 == 0, F.when(key % 3 == 0, 429).otherwise(503)).otherwise(F.col("status"))
    out = scratch(spark, "three")
    pages.select("url", bad.alias("status"), "html", (key % 4).alias("part")).write.partitionBy("part").parquet(f"{out}/pages")
    items = stored(M.order_items(spark, sf_dir), "seq")
    once = spark.read.schema(S.DETAIL_PAGES).parquet(f"{out}/pages/part=0")
    at = "2024-01-01 00:00:00"
    commits.stage(ingest.batch_tables(once, items, PORTAL, at), f"{out}/tables", 1)  # no commit follows

    def arrive():
        run = ingest.ingest_details(ingest.page_stream(spark, f"{out}/pages/part=*"), items, PORTAL, f"{out}/tables", f"{out}/state", collected_at=at)
        run.awaitTermination()
        return run

    arrive()
    pages.where(key % 14 == 0).select("url", "status", "html", F.lit(4).alias("part")).write.mode("append").partitionBy("part").parquet(f"{out}/pages")
    run = arrive()
    ingest.ingest_batch(once, items, PORTAL, f"{out}/tables", str(run.id), 0, at)
    ingest.compact(spark, f"{out}/tables")
    now = ingest.current_tables(spark, f"{out}/tables")
    c = F.col
    return (
        now.metadata.select(F.lit("metadata").alias("kind"), c("detail_url").alias("url"), c("dataset_name").alias("name"), c("column_list").alias("detail"))
        .unionByName(now.columns.select(F.lit("columns").alias("kind"), c("detail_url").alias("url"), c("dataset_name").alias("name"), F.concat_ws(" ", "seq_in_page", "name", "descr", "dtype", "length").alias("detail")))
        .unionByName(now.fails.select(F.lit("fail").alias("kind"), "url", c("stage").alias("name"), c("error").alias("detail")))
    )


@query("e2_seen", "SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS detail_url FROM pages")
def e2_seen(spark, sf_dir):
    raw = ingest.page_stream(spark, f"{sf_dir}/pages*.parquet", table(spark, sf_dir, "pages").schema)
    out = scratch(spark, "seen")
    urls = raw.select(F.regexp_replace("url", r"[?#].*$", "").alias("detail_url"))
    ingest.seen_urls(urls, f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("e3_progress_stream", E3_SQL)
def e3_progress_stream(spark, sf_dir):
    events = ingest.page_stream(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema)
    out = scratch(spark, "progress")
    lines = log_lines(events)
    ingest.ingest_progress(lines, f"{out}/tables", f"{out}/state").awaitTermination()
    return ingest.current_progress(spark, f"{out}/tables", lines.schema["job_id"].dataType.simpleString())
