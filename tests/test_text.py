"""Golden vectors of the scalar rules."""

import re

import pytest
from pyspark.sql import functions as F

from folio_spark import vocab as V
from folio_spark.functions import text as X
from folio_spark.functions import urls as U

CARD = "제공기관 한국가스공사 수정일 2024-01-02 조회수 2,930 다운로드 638"
PORTAL = "https://portal.example"

VECTORS = {
    "clean_text": (X.clean_text, [("a 　 b", "a b"), (None, ""), (" \x1f x\n", "x")]),
    "norm_key": (X.norm_key, [("관리부서 전화번호 :", "관리부서전화번호"), ("[a]-b_c/d(e)·ㆍ：", "abcde")]),
    "clean_filename": (X.clean_filename, [("a/b:c", "a_b_c"), ("  ", "unnamed"), ('x"<>|?*\\', "x_______")]),
    "title": (
        X.clean_dataset_title,
        [
            ("CSV JSON + XML 데이터명 Update", "데이터명"),
            ("한국가스공사_용수사용량 제공기관 한국가스공사 수정일 2024-01-01 조회수 2930 다운로드 638", "한국가스공사_용수사용량"),
            ("Update 대기질 현황 New", "대기질 현황"),
            ("CSV파일 목록", "파일 목록"),
            ("제공기관 현황", "제공기관 현황"),
            ("[서울시_주차장]", "서울시_주차장"),
            ("도로 현황 | 공공데이터포털", "도로 현황"),
            ("파일데이터", ""),
            (None, ""),
            ("API서비스 이용", "서비스 이용"),
            ("(", "("),
            ("()", ""),
        ],
    ),
    "title_counts": (lambda c: X.clean_dataset_title(c, unwrap=False), [("[서울시_주차장]", "[서울시_주차장]")]),
    "date_suffix": (X.strip_date_suffix, [("주차장_20240131", "주차장"), ("주차장_2024", "주차장_2024")]),
    "compare": (X.title_for_compare, [("Park Lot_20240131", "parklot")]),
    "menu": (X.is_menu_title, [("", True), ("회원가입", True), ("온비드 회원가입 현황", False), ("데이터 목록", True)]),
    "detail_url": (
        U.is_detail_url,
        [("/data/15/fileData.do", True), ("/dataset/9", True), ("/tcs/dss/selectDataSetList.do", False), (None, False)],
    ),
    "formats": (
        X.detect_formats,
        [("csv, json", ["CSV", "JSON"]), ("CSV파일", []), ("xlsx doc DOCX xls", ["XLSX", "XLS", "DOC", "DOCX"])],
    ),
    "labelled": (lambda c: X.labelled_value(c, "제공기관"), [(CARD, "한국가스공사"), ("없음", ""), ("제공기관 " + "x" * 201, "")]),
    "counts": (
        lambda c: F.concat_ws("|", X.card_counts(c)["views"], X.card_counts(c)["downloads"]),
        [(CARD, "2930|638"), ("조회수 5", "5|"), ("조회 7 다운로드 (건) 9", "|9"), ("조회 수: 3 다운로드 수 4", "3|4")],
    ),
    "counts_int": (
        lambda c: F.concat_ws("|", X.card_counts_int(c)["views"], X.card_counts_int(c)["downloads"]),
        [(CARD, "2930|638"), ("", "0|0"), ("조회 7", "7|0")],
    ),
    "only_digits": (X.only_digits, [("1,234 건", "1234"), ("없음", "없음")]),
    "only_int": (X.only_int, [("없음", 0), ("약 1,200건", 1200)]),
    "progress_int": (X.progress_int, [("1,234 ", 1234), ("x", 0), (None, 0)]),
    "date": (
        X.normalize_date,
        [
            ("2024.1.5", "2024-01-05"),
            ("2024년 3월 9일", "2024-03-09"),
            ("등록 2023/12/31 10:00", "2023-12-31"),
            ("2024-13-45", "2024-13-45"),
            ("20240105", "20240105"),
            ("수시", "수시"),
        ],
    ),
    "blocked": (
        lambda c: X.block_signal(c)["signal"],
        [
            ("429 Too Many Requests", "Too Many Requests"),
            ("HTTP 403", r"\bHTTP\s*403\b"),
            ("접근 제한 구역 현황", ""),
            ("x" * 3000 + "captcha", ""),
        ],
    ),
    "phone": (
        X.phone_number,
        [
            ("053-670-0619", "053-670-0619"),
            ("02)1234-5678", "02-1234-5678"),
            ("0536700619", "0536700619"),
            ("1577-0000", "1577-0000"),
            ("02. 2127 .5601", "02-2127-5601"),
            ("문의 +82-10-1234-5678", "+82-10-1234-5678"),
            ("044-***-1234", "044-***-1234"),
            ("담당자 없음", ""),
        ],
    ),
    "portal_phone": (X.is_portal_phone, [("관리기관 1566-0025", True), ("1566-0025", False)]),
    "tel": (
        X.format_tel_no,
        [
            ("12345678", "1234-5678"),
            ("021234567", "02-123-4567"),
            ("0212345678", "02-1234-5678"),
            ("0531234567", "053-123-4567"),
            ("010 1234 5678", "010-1234-5678"),
            ("123", "123"),
        ],
    ),
    "elapsed": (lambda c: X.fmt_elapsed(c.cast("double")), [("59", "00:59"), ("3661", "01:01:01"), ("61.9", "01:01")]),
    "clamp": (X.clamp_percent, [("150", 100), ("-3", 0), ("x", 0), (None, 0), ("42", 42)]),
    "safe_org": (X.safe_org_name, [("한국중부발전(주)", "한국중부발전_주")]),
    "sheet": (lambda c: X.sheet_name(c, F.lit(2)), [("메타/데이터", "메타_데이터_002"), ("", "Sheet_002"), ("x" * 40, "x" * 27 + "_002")]),
    "orgs": (
        X.org_variations,
        [("가 나", ["가 나", "가나", "가 나㈜", "가 나(주)", "㈜가 나", "(주)가 나", "가나㈜", "가나(주)", "가 나(재)", "(재)가 나", "가나(재)"])],
    ),
    "candidates": (
        lambda c: U.detail_candidates(c, PORTAL),
        [
            (
                "https://h/data/15/fileData.do",
                ["https://h/data/15/fileData.do", f"{PORTAL}/dataset/15/fileData.do?lang=ko", f"{PORTAL}/data/15/fileData.do"],
            ),
            (f"{PORTAL}/data/15/fileData.do", [f"{PORTAL}/data/15/fileData.do", f"{PORTAL}/dataset/15/fileData.do?lang=ko"]),
            ("https://h/dataset/9", ["https://h/dataset/9"]),
            ("", []),
        ],
    ),
    "short_error": (X.is_short_html_error, [("RuntimeError('EMPTY_OR_SHORT_HTML status=200')", True), ("x", False)]),
    "phone_after": (X.phone_after_label, [("관리부서 전화 번호 053-670-0619 보유근거 x", "053-670-0619"), ("담당부서 전화번호: 미정 키워드 a", "미정")]),
}


@pytest.mark.parametrize("name", list(VECTORS))
def test_vectors(spark, name):
    rule, cases = VECTORS[name]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(rule(F.col("s"))).collect()]
    assert got == [c[1] for c in cases]


def test_dataset_title_prefers_trusted_anchor(spark):
    rows = [
        ("가 현황", "가 현황", "anchor", "나 현황_20240101", "가 현황"),
        ("가 현황", "가 현황", "title_selector", "나 현황_20240101", "나 현황"),
        ("가 현황", "가 현황", "title_selector", "가현황_20240101", "가 현황"),
        ("회원가입", "다 현황", "anchor", "", "다 현황"),
        ("", "", "direct_url", "라 현황", "라 현황"),
        ("", "", "direct_url", "회원가입", ""),
    ]
    df = spark.createDataFrame(rows, "t string, r string, s string, f string, want string")
    got = df.select(X.dataset_title(F.col("t"), F.col("r"), F.col("s"), F.col("f")).alias("g"), "want").collect()
    assert [r.g for r in got] == [r.want for r in got]


def test_windows_of_the_rules_can_be_lifted(spark):
    from folio_spark.functions import detail_html as D

    late = "가 " * 5000
    row = spark.createDataFrame([(late + "Too Many Requests", late + "조회수 5")], "t string, v string").select(
        X.block_signal(F.col("t"))["blocked"].alias("near"), X.block_signal(F.col("t"), None)["blocked"].alias("far"),
        D.invalid_reason(F.col("t"), F.lit("")).alias("r"),
    ).first()
    assert (row.near, row.far, row.r) == (False, True, "")


def test_phone_patterns_wait_for_a_digit(spark):
    """Texts without a digit, which most are, are told by one search; what counts as a digit follows Unicode."""
    def literal(text: str) -> str:
        hit = next((m[0] for p in V.PHONE_PATTERNS if (m := re.search(p, " ".join(text.split())))), "")
        return re.sub("^-|-$", "", re.sub("-+", "-", re.sub(r"\s+", "", hit).translate(str.maketrans(".)", "--"))))

    texts = ["번호 없음", "xxx-xxxx", "***-****", "١٢-xxx-****", "044 - ***-1234", "053-670-0619", "1xxx-****", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.phone_number(F.col("t")).alias("p"))
    assert {r.t: r.p for r in df.collect()} == {t: literal(t) for t in texts}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find(r"(?U)\d)") < plan.find("regexp_extract")


def test_words_that_spare_a_search_stand_wherever_a_pattern_matches(spark):
    """Whatever letter counts as one of a pattern's in another case, the cheap test sees it as well."""
    chars = spark.range(1, 0xD800).selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c")
    letters = {"title": "newupdat업데이트", "block": "".join(sorted({w[0] for w in V.BLOCK_PATTERN_WORDS.split("|")}))}
    odd = chars.where(F.col("c").rlike(X.rx(f"^[{letters['title']}]$", True)) != F.col("c").rlike(f"(?i)^[{letters['title']}]$"))
    first = X.BLOCK_WORDS[len("(?=") :].split(")")[0]
    odder = chars.where(F.col("c").rlike(X.rx(f"^[{letters['block']}]$", True)) != F.col("c").rlike(f"^{first}$"))
    assert odd.count() == 0 and odder.count() == 0
    assert set(V.BLOCK_PATTERN_HINTS) >= {next(h for h in V.BLOCK_PATTERN_HINTS if h in p) for p in V.BLOCK_PATTERNS}
    assert V.TITLE_PORTAL in V.TITLE_PORTAL_TAIL


def test_titles_cleaned_as_by_every_pattern(spark):
    """The steps one after the other, none spared."""
    titles = ["New a_b", "a NEW b", "a_b updated", "csv Update x 업데이트", "newer", "CSV 자료 - 공공데이터포털", "a 제공기관 b New", "(a New)", "x Update 제공기관", "공공데이터포털 a", "", "a_b_20240101"]

    def plainly(c, unwrap):
        c = X.clean_text(c)
        for p in (V.TITLE_BADGES, V.TITLE_STATUS_HEAD, V.TITLE_STATUS_TAIL, V.TITLE_NEW_ANYWHERE):
            c = X.erase(c, p, True)
        c = X.let(c, X._cut_at_marker)
        c = X.erase(X.erase(c, V.TITLE_STATUS_TAIL, True) if unwrap else c, V.TITLE_PORTAL_TAIL)
        c = X.clean_text(c)
        return F.when(c.rlike(V.TITLE_WRAPPED), F.trim(F.substring(c, F.lit(2), F.length(c) - 2))).otherwise(c) if unwrap else c

    rows = spark.createDataFrame([(t,) for t in titles], "t string")
    both = rows.select("t", *[f.alias(f"{n}{u}") for u in (True, False) for n, f in (("a", X.clean_dataset_title(F.col("t"), u)), ("b", plainly(F.col("t"), u)))])
    assert all(r["aTrue"] == r["bTrue"] and r["aFalse"] == r["bFalse"] for r in both.collect())
