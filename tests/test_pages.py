"""Page extraction on hand-written markup."""

from pyspark.sql import functions as F

from folio_spark import vocab as V
from folio_spark.functions import detail_html as D
from folio_spark.functions import html as H
from folio_spark.functions import tree as T
from folio_spark.operators import detail as DT
from folio_spark.operators import listing as L
from folio_spark.operators.attempts import fail_rows
from folio_spark.plans.metadata import collect_details

PORTAL = "https://portal.example"


def one(spark, html, rule):
    return spark.createDataFrame([(html,)], "h string").select(rule(F.col("h")).alias("x")).first().x


def in_tree(spark, html, rule):
    trees = spark.createDataFrame([(html,)], "h string").select(T.tree(H.visible(F.col("h"))).alias("t"))
    return trees.select(rule(F.col("t")).alias("x")).first().x


def text(spark, html):
    return one(spark, html, lambda h: H.text_of(H.visible(h)))


def test_text_drops_hidden_parts(spark):
    html = "<p>a<b>b</b><!-- c --> <script>var d='</p>';</script><style>e</style>&lt;f&gt; &amp;lt; &#44032;&#xAC01; &nbsp;g 1 < 2</p>"
    assert text(spark, html) == "a b <f> &lt; 가각 g 1 < 2"
    assert text(spark, None) == ""


def test_container_ends_at_its_own_tag(spark):
    html = '<div class="x result-list"><div>i</div><ul><li>1</li><li>2<ul></ul></div><ul><li>3</li></ul>'
    got = in_tree(spark, html, lambda t: F.transform(L._list_items(t, L.RESULT_LIST), lambda n: T.text_of(t, n)))
    assert got == ["1", "2"]


def test_cards_titles_and_fallback(spark):
    card = (
        '<div class="result-list"><ul>'
        '<li><a href="/x">no</a><a href="/data/1/fileData.do"> CSV 교통_현황 Update </a></li>'
        '<li><a href="../dataset/2">로그인</a><span class="title">주차_현황</span></li>'
        '<li><a href="/data/3">로그인</a></li>'
        '<li><a href="/data/1/fileData.do">again</a></li><li><a href="/data/list">bad</a></li></ul></div>'
    )
    loose = '<p><a href="/data/7">JSON 날씨</a><a href="/data/7">twice</a><a href="/about">x</a></p>'
    pages = spark.createDataFrame(
        [("o", 1, PORTAL + "/a/list?p=1", card), ("o", 2, PORTAL + "/a/list?p=2", loose)], "org string, page_no int, list_url string, html string"
    )
    rows = [(r.page_no, r.title, r.raw_title, r.title_source, r.detail_url, r.formats) for r in L.cards(pages).orderBy("page_no", "pos").collect()]
    assert rows == [
        (1, "교통_현황", "교통_현황", "anchor", PORTAL + "/data/1/fileData.do", ""),
        (1, "주차_현황", "주차_현황", "title_selector", PORTAL + "/dataset/2", ""),
        (1, "로그인", "로그인", "anchor_raw", PORTAL + "/data/3", ""),
        (2, "날씨", "JSON 날씨", "fallback_anchor", PORTAL + "/data/7", "JSON"),
    ]


def test_counts_use_file_list_when_no_result_list(spark):
    html = '<div id="fileDataList"><ul><li><a href="/data/5/fileData.do">도로</a> 조회 7 다운로드 9</li></ul></div>'
    pages = spark.createDataFrame([("o", 1, "l", html)], "org string, page_no int, list_url string, html string")
    r = L.counts_cards(pages, PORTAL).first()
    assert (r.title, r.views, r.downloads, r.detail_url) == ("도로", 7, 9, PORTAL + "/data/5/fileData.do")


def pairs(spark, html):
    return [tuple(p) for p in in_tree(spark, html, lambda t: D.table_pairs(t, D.tables_with_headers(t)))]


def test_table_pairs(spark):
    assert pairs(spark, "<table><tr><td>k1<td>v1<td>k2<td>v2</table>") == [("k1", "v1"), ("k2", "v2")]
    assert pairs(spark, "<table><tr><th>k<th>x<td>v</tr><tr><th>only</tr></table>") == [("x", "v")]
    assert pairs(spark, f"<table><tr><th>{'k' * 81}</th><td>v</td></tr></table>") == []
    phone = "<table><tr><th>관리부서 전화번호</th><td><span id=t></span><script>$('#t').text('02-1234-5678')</script></td></tr></table>"
    assert pairs(spark, phone) == [("관리부서 전화번호", "02-1234-5678")]


def test_column_rows(spark):
    html = (
        "<table><tr><th>항목명</th><th>항목 설명</th></tr><tr><td>정보시스템명</td><td>DB명</td><td>Table명</td></tr>"
        "<tr><td>a</td><td>d</td></tr><tr><td>b</td></tr><tr><td>설명</td><td>x</td></tr><tr></tr></table>"
    )
    got = in_tree(spark, html, lambda t: D.column_rows(D.tables_with_headers(t)))
    assert [tuple(r) for r in got] == [("a", "d", "", "")]


def test_block_prefers_full_section(spark):
    body = "파일데이터 정보 서비스 안내 문구 파일데이터명 A 분류체계 B 제공기관 C 키워드 D 오픈API 정보 키워드 E"
    assert one(spark, body, D.text_block) == "파일데이터명 A 분류체계 B 제공기관 C 키워드 D "
    assert one(spark, "파일데이터명 A 분류체계 B", D.text_block) == ""


def test_full_details_keep_invalid_and_missing(spark):
    filler = "내용 " * 200
    pages = spark.createDataFrame(
        [
            (PORTAL + "/dataset/77/fileData.do?lang=ko", 200, f"<p>잘못된 접근입니다</p><p>{filler}</p>"),
            (PORTAL + "/data/77/fileData.do", 403, filler),
            (PORTAL + "/data/78/fileData.do", 200, "짧다"),
            (PORTAL + "/data/79/fileData.do", 404, f"<table><tr><th>키워드</th><td>길</td></tr></table>{filler}"),
        ],
        "url string, status int, html string",
    )
    blank = {c: "" for c in ("title", "raw_title", "title_source", "formats", "views", "downloads", "source_list_url")}
    items = spark.createDataFrame(
        [dict(blank, seq=i, detail_url=f"{PORTAL}/data/{n}/fileData.do") for i, n in enumerate((77, 78, 79), 1)],
        "seq long, detail_url string, " + ", ".join(f"{c} string" for c in blank),
    ).select("*", *[F.lit(None).cast("string").alias(c) for c in V.CARD_TARGETS])
    run = collect_details(items, pages, PORTAL, "2024-01-01 00:00:00")
    rows = {r.seq: r for r in run.metadata.collect()}
    assert rows[1].dataset_name == V.NEEDS_CHECK_PREFIX + "77" and "잘못된 접근입니다" in rows[1].data_limit
    assert rows[3].keywords == "길" and set(rows) == {1, 3}
    assert run.columns.count() == 2 and all(r.detail_url == "" for r in run.columns.collect())
    fails = run.fails.collect()
    assert [f.seq for f in fails] == ["2"] and "EMPTY_OR_SHORT_HTML status=200, len=2" in fails[0].error and "NO_RESPONSE" in fails[0].error


def test_department_phone_empty_cell_ends_search(spark):
    html = "<table><tr><th>관리부서 전화번호</th><td> </td></tr></table><b>관리부서 전화번호</b><i>02-111-2222</i>"
    assert in_tree(spark, html, lambda t: D.department_phone(t, F.lit(""))) == ""
    assert in_tree(spark, html.split("</table>")[1], lambda t: D.department_phone(t, F.lit(""))) == "02-111-2222"
