"""Words, labels, patterns and thresholds of the catalogue portal.

Everything here must stay exactly as it is for results to be right; the
operators only read it. Patterns are written for Java with ``(?U)`` added by
``functions.text.rx`` so that classes and word boundaries are Unicode aware.
"""

from __future__ import annotations

# --- output schemas: (internal name, header at the sink), fixed order ---------
METADATA_FIELDS = [
    ("seq", "최종순번"),
    ("dataset_name", "파일데이터명"),
    ("provider", "제공기관"),
    ("category", "분류체계"),
    ("formats", "확장자"),
    ("total_rows", "전체 행"),
    ("keywords", "키워드"),
    ("description", "설명"),
    ("column_list", "컬럼목록"),
    ("detail_url", "상세페이지 URL"),
    ("dept", "관리부서명"),
    ("dept_phone", "관리부서 전화번호"),
    ("legal_basis", "보유근거"),
    ("collect_method", "수집방법"),
    ("update_cycle", "업데이트 주기"),
    ("next_due", "차기 등록 예정일"),
    ("media_type", "매체유형"),
    ("data_limit", "데이터 한계"),
    ("views", "조회수"),
    ("downloads", "다운로드(바로가기)"),
    ("registered", "등록일"),
    ("modified", "수정일"),
    ("provide_type", "제공형태"),
    ("notes", "기타 유의사항"),
    ("spatial", "공간범위"),
    ("temporal", "시간범위"),
    ("fee", "비용부과유무"),
    ("fee_basis", "비용부과기준 및 단위"),
    ("license", "이용허락범위"),
    ("source_label", "수집파일"),
]
COLUMN_FIELDS = [
    ("dataset_name", "파일데이터명"),
    ("detail_url", "상세페이지 URL"),
    ("seq_in_page", "순번"),
    ("name", "항목명"),
    ("descr", "항목설명"),
    ("dtype", "데이터타입"),
    ("length", "데이터 길이"),
]
FAIL_FIELDS = [
    ("collected_at", "수집시각"),
    ("stage", "단계"),
    ("dataset_name", "파일데이터명"),
    ("url", "URL"),
    ("seq", "최종순번"),
    ("views", "조회수"),
    ("downloads", "다운로드(바로가기)"),
    ("error", "오류"),
    ("traceback", "Traceback"),
]
COUNT_FIELDS = [
    ("title", "데이터명"),
    ("views", "조회수"),
    ("downloads", "다운로드수"),
    ("detail_url", "상세페이지 URL"),
]
# Columns a user may pick for an organisation report, in menu order.
SELECTABLE = [
    "dataset_name", "category", "provider", "dept", "dept_phone", "description",
    "keywords", "column_list", "total_rows", "formats", "media_type", "provide_type",
    "update_cycle", "next_due", "registered", "modified", "legal_basis", "collect_method",
    "data_limit", "notes", "spatial", "temporal", "fee", "fee_basis", "license",
    "downloads", "detail_url",
]

# --- label spellings on detail pages, grouped by the field they fill ----------
LABEL_SPELLINGS = {
    "dataset_name": ["파일데이터명", "제목", "데이터명"],
    "provider": ["제공기관", "기관명"],
    "category": ["분류체계", "분류"],
    "formats": ["확장자", "파일형식", "제공형식"],
    "total_rows": ["전체행", "전체 행", "전체건수", "전체 건수", "데이터건수", "데이터 건수", "행수"],
    "keywords": ["키워드", "검색키워드"],
    "description": ["설명", "데이터설명", "파일데이터 설명"],
    "dept": ["관리부서명", "관리부서"],
    "dept_phone": [
        "관리부서전화번호", "관리부서 전화번호", "관리부서 전화 번호", "담당부서전화번호",
        "담당부서 전화번호", "담당부서 전화 번호", "전화번호",
    ],
    "legal_basis": ["보유근거"],
    "collect_method": ["수집방법"],
    "update_cycle": ["업데이트주기", "업데이트 주기", "갱신주기", "제공주기"],
    "next_due": ["차기등록예정일", "차기 등록 예정일", "차기등록일"],
    "media_type": ["매체유형", "매체 유형"],
    "data_limit": ["데이터한계", "데이터 한계"],
    "downloads": ["다운로드", "다운로드수", "다운로드 수", "다운로드(바로가기)", "바로가기"],
    "registered": ["등록일", "최초등록일", "최초 등록일"],
    "modified": ["수정일", "최종수정일", "최종 수정일", "수정일자"],
    "provide_type": ["제공형태", "제공 형태"],
    "notes": ["기타유의사항", "기타 유의사항", "유의사항"],
    "spatial": ["공간범위", "공간 범위"],
    "temporal": ["시간범위", "시간 범위"],
    "fee": ["비용부과유무", "비용부과 유무"],
    "fee_basis": ["비용부과기준및단위", "비용부과 기준 및 단위", "비용부과기준 및 단위"],
    "license": ["이용허락범위", "이용허락 범위"],
}
# A value equal to one of these is a neighbouring label read by mistake.
POLLUTED_VALUES = [
    "수집방법", "다운로드(바로가기)", "시간범위", "이용허락범위", "보유근거", "데이터 한계", "기타 유의사항",
]

# --- dataset titles -----------------------------------------------------------
FORMATS = [
    "CSV", "JSON", "XML", "XLSX", "XLS", "PDF", "HWP", "HWPX", "TXT", "ZIP", "SHP",
    "MP4", "AVI", "MOV", "WMV", "JPG", "JPEG", "PNG", "GIF", "DOC", "DOCX", "PPT", "PPTX",
]
TITLE_BADGES = (
    r"^(?:(?:CSV|JSON|XML|XLSX|XLS|PDF|HWPX|HWP|TXT|ZIP|SHP|MP4|AVI|MOV|WMV|JPG|JPEG|PNG|GIF|"
    r"DOCX|DOC|PPTX|PPT|파일데이터|오픈API|API)\s*(?:\+|,|/|\\|｜|·|ㆍ|-)?\s*)+"
)
TITLE_STATUS_HEAD = r"^\s*(?:New|Update|Updated|업데이트)\s+"
TITLE_STATUS_TAIL = r"\s+(?:New|Update|Updated|업데이트)\s*$"
TITLE_NEW_ANYWHERE = r"\bNew\b"
TITLE_PORTAL = "공공데이터포털"  # what the pattern below holds
TITLE_PORTAL_TAIL = r"\s*[|｜-]\s*공공데이터포털\s*$"
TITLE_CUT_MARKERS = [
    "제공기관", "분류체계", "수정일", "등록일", "조회수", "조회 수", "다운로드수", "다운로드 수", "다운로드", "키워드",
]
TITLE_WRAPPED = r"(?s)^(?:\(.*\)|\[.*\]|<.*>|〈.*〉)$"
TITLE_DATE_TAIL = r"_20\d{6}$"
MENU_PHRASES = ["기업 공공데이터 문제해결 지원센터", "공공데이터 활용기업 문제해결 지원신청"]
MENU_WORDS = [
    "데이터목록", "조건검색", "데이터찾기", "국가데이터맵", "데이터요청", "데이터활용", "정보공유",
    "이용안내", "사이트맵", "로그인", "회원가입", "ENGLISH", "공공데이터포털", "DATA.GO.KR",
]
DETAIL_STOP_TITLES = ["데이터 상세", "파일데이터", "상세", "공공데이터포털"]
TITLE_CLASSES = ["data-title", "title", "tit", "view-title", "dataset-title"]
TITLE_TAGS = ["h1", "h2", "h3", "title"]

# --- listing cards ------------------------------------------------------------
CARD_VALUE_LABELS = [
    "제공기관", "분류체계", "등록일", "수정일", "조회수", "조회 수", "다운로드수", "다운로드 수", "다운로드",
    "관리부서명", "관리부서 전화번호", "업데이트 주기", "제공형태", "비용부과유무",
]
CARD_TARGETS = {"provider": "제공기관", "category": "분류체계", "registered": "등록일", "modified": "수정일"}
COUNT_PAIR_PATTERNS = [
    r"조회\s*수\s*[:：]?\s*[0-9][0-9,]*\s+다운로드\s*[:：]?\s*[0-9][0-9,]*",
    r"조회수\s*[:：]?\s*[0-9][0-9,]*\s+다운로드수?\s*[:：]?\s*[0-9][0-9,]*",
    r"조회\s*수\s*[:：]?\s*[0-9][0-9,]*\s+다운로드\s*수\s*[:：]?\s*[0-9][0-9,]*",
]
VIEW_LABELS = ["조회수", "조회 수"]
DOWNLOAD_LABELS = ["다운로드수", "다운로드 수", "다운로드"]
COUNT_AFTER_LABEL = [r"\s*[:：]?\s*([0-9][0-9,]*)", r"\s*\(?\s*건\s*\)?\s*[:：]?\s*([0-9][0-9,]*)"]
LOOSE_VIEW_PATTERN = r"조회\s*수?\s*[:：]?\s*([0-9][0-9,]*)"
LOOSE_DOWNLOAD_PATTERN = r"다운로드\s*수?\s*[:：]?\s*([0-9][0-9,]*)"
TOTAL_COUNT_PATTERNS = [r"총\s*([0-9,]+)\s*건이\s*검색", r"총\s*([0-9,]+)\s*건"]
DETAIL_DOWNLOAD_PATTERNS = [
    r"다운로드\s*\(?바로가기\)?\s*([0-9,]+)", r"다운로드수\s*([0-9,]+)", r"다운로드\s*([0-9,]+)",
]
DATE_PATTERN = r"(20\d{2})[.\-/년\s]+(\d{1,2})[.\-/월\s]+(\d{1,2})"

# --- list addresses -----------------------------------------------------------
LIST_PATH = "/tcs/dss/selectDataSetList.do"
LIST_PARAMS = [
    ("dType", "{d_type}"), ("keyword", ""), ("detailKeyword", ""), ("publicDataPk", ""),
    ("recmSe", "N"), ("detailText", ""), ("relatedKeyword", ""), ("commaNotInData", ""),
    ("commaAndData", ""), ("commaOrData", ""), ("must_not", ""), ("tabId", ""),
    ("dataSetCoreTf", ""), ("coreDataNm", ""), ("sort", "{sort}"), ("relRadio", ""),
    ("orgFullName", "{org}"), ("orgFilter", "{org}"), ("org", "{org}"), ("orgSearch", ""),
    ("currentPage", "{page}"), ("perPage", "{per_page}"), ("brm", ""), ("instt", ""),
    ("svcType", ""), ("kwrdArray", ""), ("extsn", ""), ("coreDataNmArray", ""),
    ("conditionType", "search"), ("operator", "AND"), ("pblonsipScopeCode", "PBDE07"),
]
ORG_KEYS = ["org", "orgFilter", "orgFullName"]

# --- detail pages: text block -------------------------------------------------
BLOCK_MARKERS = ["파일데이터명", "파일데이터 정보"]
BLOCK_WINDOW = 8000
BLOCK_END = "오픈API 정보"
BLOCK_REQUIRED = ["분류체계", "제공기관"]
BLOCK_NAME_LABEL = "파일데이터명"
BLOCK_SERVICE_WORD = "서비스"
BLOCK_LABELS = [
    "파일데이터명", "분류체계", "제공기관", "관리부서명", "관리부서 전화번호", "관리부서 전화 번호",
    "담당부서 전화번호", "보유근거", "수집방법", "업데이트 주기", "차기 등록 예정일", "매체유형",
    "전체 행", "확장자", "키워드", "데이터 한계", "조회수", "다운로드(바로가기)", "등록일", "수정일",
    "제공형태", "설명", "기타 유의사항", "공간범위", "시간범위", "비용부과유무",
    "비용부과기준 및 단위", "이용허락범위",
]
BLOCK_STOP_PHRASES = [
    "공공데이터활용지원센터는", "오픈 API를 활용하기 위해서는", "XML JSON", "활용신청", "오픈API 정보",
    "다른 사용자들이 활용한 데이터",
]
MAX_LABEL_LENGTH = 80
CARD_VALUE_CHARS = 200

# --- detail pages: column tables ----------------------------------------------
HEADER_NAME_KEYS = ["항목명", "컬럼명", "필드명"]
HEADER_DESC_KEYS = ["항목설명", "컬럼설명", "설명"]
HEADER_TYPE_KEYS = ["데이터타입", "타입"]
HEADER_LENGTH_KEYS = ["최대길이", "데이터길이", "길이"]
HEADER_EXTRA_KEYS = ["항목설명", "컬럼설명", "최대길이", "데이터길이"]
HEADER_SEARCH_ROWS = 4
COLUMN_SKIP_WORDS = [
    "정보시스템명", "DB명", "Table명", "테이블명",
    "파일데이터명", "분류체계", "제공기관", "관리부서명", "관리부서 전화번호",
    "보유근거", "수집방법", "업데이트 주기", "차기 등록 예정일", "매체유형",
    "전체 행", "확장자", "키워드", "데이터 한계", "다운로드(바로가기)",
    "등록일", "수정일", "제공형태", "설명", "기타 유의사항", "공간범위",
    "시간범위", "비용부과유무", "비용부과기준 및 단위", "이용허락범위",
    "서비스", "관리기관", "관리기관 전화번호", "활용신청",
]
SUBHEADER_RUNS = ["정보시스템명DB명Table명", "정보시스템명DB명테이블명"]
SUBHEADER_RUNS_LATE = SUBHEADER_RUNS + ["정보시스템명데이터베이스명Table명"]

# --- detail pages: invalid responses --------------------------------------------
INVALID_HEAD = 8000
LIST_PAGE_QUESTION = "어떤 공공데이터를 찾으시나요"
LIST_PAGE_SEARCH = "조건검색"
LIST_PAGE_FOUND = "건이 검색되었습니다"
LIST_PAGE_NAME = "데이터목록"
LIST_PAGE_WORDS = [LIST_PAGE_FOUND, LIST_PAGE_SEARCH]  # a listing page says one of these
UNAVAILABLE_PHRASES = [
    "요청하신 페이지를 찾을 수 없습니다", "페이지를 찾을 수 없습니다", "존재하지 않는 페이지",
    "잘못된 접근입니다", "비정상적인 접근입니다", "비정상적인 접근으로 판단", "접근 권한이 없습니다",
    "페이지 접근이 제한되었습니다",
]
NEEDS_CHECK_PREFIX = "상세페이지 확인필요_"
INVALID_NOTE = "상세페이지가 정상 파일데이터 상세화면이 아니어서 목록 수집값 기준으로 저장했습니다. [%s]"
DEFAULT_SOURCE_LABEL = "실시간수집"
RETRY_SOURCE_LABEL = "실패로그_재수집"
ORG_SOURCE_LABEL = "기관별수집"

# --- phones -------------------------------------------------------------------
PHONE_PATTERNS = [
    r"(?:\+?82[-\s]?)?0\d{1,2}\s*[\)\-\.]?\s*[0-9xX*]{3,4}\s*[\-\.]?\s*[0-9xX*]{4}",
    r"(?:\+?82[-\s]?)?10\s*[\-\.]?\s*[0-9xX*]{4}\s*[\-\.]?\s*[0-9xX*]{4}",
    r"1[0-9xX*]{3}\s*[\-\.]?\s*[0-9xX*]{4}",
    r"\d{2,4}\s*[\-\.]\s*[0-9xX*]{3,4}\s*[\-\.]\s*[0-9xX*]{4}",
]
PORTAL_PHONE = "1566-0025"
PORTAL_TERMS = ["공공데이터활용지원센터", "공공데이터 개방문의", "대표번호", "관리기관", "오픈API", "오픈 API"]
PHONE_LABELS = ["관리부서 전화번호", "관리부서 전화 번호", "담당부서 전화번호", "담당부서 전화 번호"]
PHONE_LABEL_PATTERN = r"관리\s*부서\s*전화\s*번호|담당\s*부서\s*전화\s*번호"
PHONE_LABEL_END = "번호"  # what the pattern above ends in
PHONE_STOP_LABELS = [
    "관리부서명", "보유근거", "수집방법", "업데이트 주기", "차기 등록 예정일", "매체유형", "전체 행", "확장자",
    "키워드", "데이터 한계", "조회수", "다운로드(바로가기)", "등록일", "수정일", "제공형태", "설명",
    "기타 유의사항", "공간범위", "시간범위", "비용부과유무", "비용부과기준 및 단위", "이용허락범위",
]
PHONE_ATTRIBUTES = ["value", "data-value", "data-tel", "data-phone", "title", "aria-label", "onclick"]
PHONE_LOOKAHEAD_TAGS = 8

# --- responses ----------------------------------------------------------------
REJECTED_STATUS = [403, 429, 500, 502, 503, 504]
BLOCKING_STATUS = [403, 429]
SHORT_HTML_CHARS = 500
MAX_ATTEMPTS = 4
BLOCK_HEAD = 3000
BLOCK_PHRASES = [
    "비정상적인 접근입니다", "비정상적인 접근으로 판단", "요청이 너무 많습니다", "요청이 많아",
    "Too Many Requests", "Access Denied", "Service Unavailable", "서비스 이용이 원활하지 않습니다",
    "자동입력 방지", "captcha", "CAPTCHA",
]
BLOCK_PATTERNS = [
    r"\bHTTP\s*429\b", r"\b429\s+Too\s+Many\s+Requests\b", r"\bError\s*429\b",
    r"\bHTTP\s*403\b", r"\b403\s+Forbidden\b", r"\bError\s*403\b",
    r"\bStatus\s*Code\s*[:=]?\s*429\b", r"\bStatus\s*Code\s*[:=]?\s*403\b",
    r"페이지\s*접근이\s*제한되었습니다", r"접근\s*권한이\s*없습니다",
]
BLOCK_PATTERN_HINTS = ["429", "403", "접근"]  # every pattern above contains one of these
BLOCK_PATTERN_WORDS = r"HTTP|Too|Error|Forbidden|Code|접근"  # and one of these
SHORT_HTML_SIGNALS = ["EMPTY_OR_SHORT_HTML", "RETRY_FAILED_EMPTY_OR_SHORT_HTML"]
RETRY_WAIT_SECONDS = 180
BLOCK_COOLDOWN_STEP = 4
BLOCK_COOLDOWN_STEPS = 3
BLOCK_COOLDOWN_MAX = 12

# --- organisations and files -----------------------------------------------------
ORG_PAGE_SIZE = 10
ORG_WALK_PAGE_SIZE = 100
ORG_WALK_EXTRA_PAGES = 5
ORG_REPORT_PAGE_SIZE = 1000
ORG_REPORT_EXTRA_PAGES = 2
UNNAMED = "unnamed"
HISTORY_DIR = "과거데이터"
HISTORY_MARK = "과거"
SHEET_NAME_CHARS = 31
SHEET_DEFAULT = "Sheet"
CHUNK_ROWS = 1_000_000
CHUNK_ROWS_MAX = 1_048_575

# --- log lines ----------------------------------------------------------------
LOG_LIST_START = r"\[LIST\]\s+page\s+(\d+)\s*/\s*(\d+)\s+수집\s+중"
LOG_LIST_DONE = r"\[LIST\]\s+page\s+(\d+).*?\+\s*(\d+)건\s*\|\s*누적\s*([\d,]+)\s*/\s*([\d,]+)"
LOG_URLS_DONE = r"상세\s*URL\s*수집\s*완료.*?([\d,]+)건"
LOG_DETAIL = (
    r"\[.*?DETAIL.*?\]\s*([\d,]+)\s*/\s*([\d,]+)\s*\(\s*([\d.]+)%\s*\).*?"
    r"성공\s*([\d,]+)\s*\|\s*실패\s*([\d,]+)"
)
LOG_RECOVERY = ["[후순위 처리]", "[Playwright 최종 회수]", "[Playwright 회수]"]
LOG_FINISH = ["수집 완료", "전체 완료"]
MSG_URLS_DONE = r"상세\s*URL\s*([\d,]+)건\s*수집\s*완료"
MSG_FILE = ["엑셀", "파일을 생성"]
MSG_URLS = ["상세 URL", "수집"]
MSG_DETAIL = ["상세 HTML", "메타데이터"]
DL_PAGE = [r"파일데이터 목록\s+(\d+)페이지", r"(\d+)페이지 완료"]
DL_TARGETS = r"다운로드 대상 데이터셋\s+([\d,]+)건"
DL_ITEM = r"\[(\d+)\s*/\s*(\d+)\]"
DL_CURRENT_SAVED = "현재데이터 저장"
DL_HISTORY = ["과거데이터", "저장"]
DL_FAILED = ["실패", "오류"]
DL_DONE = "전체 다운로드 완료"
COUNTS_PAGE = [r"목록\s+(\d+)페이지", r"(\d+)페이지 완료"]
COUNTS_DONE = "수집 완료"
