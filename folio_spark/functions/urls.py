"""URL rules as native ``Column`` expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V
from .text import clean_text, filled, first_filled, let

URL_PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
DATASET_ID = r"/(?:data|dataset)/(\d+)"
FILE_PAGE_ID = [r"/data/(\d+)/fileData\.do", r"/dataset/(\d+)/fileData\.do"]


def url_parts(c: Column) -> Column:
    names = ["scheme", "authority", "path", "query", "fragment"]
    return F.struct(*[F.regexp_extract(c, URL_PARTS, i + 1).alias(n) for i, n in enumerate(names)])


def _resolve_dots(path: Column) -> Column:
    """Drop ``.`` and ``..`` segments of an absolute path."""

    def step(kept: Column, seg: Column) -> Column:
        return (
            F.when(seg == ".", kept)
            .when((seg == "..") & (F.size(kept) > 1), F.slice(kept, F.lit(1), F.size(kept) - 1))
            .when(seg == "..", kept)
            .otherwise(F.concat(kept, F.array(seg)))
        )

    segments = F.split(path, "/")
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    joined = F.array_join(kept, "/")
    ended = F.when(path.rlike(r"/\.\.?$"), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.when(ended == "", "/").otherwise(ended)).otherwise(path)


def absolute_url(base: Column, href: Column) -> Column:
    """Resolve ``href`` against the page address the way a browser does."""

    def join(p: Column) -> Column:
        b, h = p["b"], p["h"]
        host = F.concat(b["scheme"], F.lit("://"), b["authority"])
        folder = F.regexp_replace(b["path"], r"[^/]*$", "")
        folder = F.when(folder == "", "/").otherwise(folder)
        relative = F.regexp_replace(F.concat(folder, h["path"]), "//+", "/")
        path = F.when(h["path"].startswith("/"), h["path"]).otherwise(relative)
        tail = F.concat(h["query"], h["fragment"])
        return (
            F.when(p["href"] == "", "")
            .when(h["scheme"] != "", p["href"])
            .when(p["href"].startswith("//"), F.concat(b["scheme"], F.lit(":"), p["href"]))
            .when((h["path"] == "") & (h["query"] == ""), F.concat(host, b["path"], b["query"], h["fragment"]))
            .when(h["path"] == "", F.concat(host, b["path"], tail))
            .otherwise(F.concat(host, _resolve_dots(path), tail))
        )

    link = F.trim(F.coalesce(href, F.lit("")))
    return let(F.struct(url_parts(base).alias("b"), url_parts(link).alias("h"), link.alias("href")), join)


def is_detail_url(c: Column) -> Column:
    return let(
        F.lower(F.coalesce(c, F.lit(""))),
        lambda u: (u.contains("/data/") | u.contains("/dataset/"))
        & (u.contains("filedata.do") | u.contains("dataid=") | u.rlike(r"(?U)/(?:data|dataset)/\d+")),
    )


def is_counts_url(c: Column) -> Column:
    """The narrower, case-sensitive test of the counts and download walks."""
    return c.contains("fileData.do") | c.rlike(r"(?U)" + DATASET_ID)


def dataset_id(c: Column) -> Column:
    return F.regexp_extract(clean_text(c), r"(?U)" + DATASET_ID, 1)


def detail_candidates(url: Column, portal_base: str) -> Column:
    """The original address and the portal's two alternative forms, without repeats."""

    def forms(u: Column) -> Column:
        ident = first_filled(*[F.regexp_extract(u, r"(?U)" + p, 1) for p in FILE_PAGE_ID])
        return let(
            ident,
            lambda i: F.when(
                i != "",
                F.array_distinct(
                    F.array(
                        u,
                        F.concat(F.lit(portal_base + "/dataset/"), i, F.lit("/fileData.do?lang=ko")),
                        F.concat(F.lit(portal_base + "/data/"), i, F.lit("/fileData.do")),
                    )
                ),
            ).otherwise(F.filter(F.array(u), lambda x: x != "")),
        )

    return let(clean_text(url), forms)


# --- query strings ------------------------------------------------------------------
def form_encode(c: Column) -> Column:
    """Form encoding with ``~`` left alone and ``*`` escaped."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def form_decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def query_pairs(url: Column) -> Column:
    """array<struct<k, v>> of decoded query parameters, in order, blanks kept."""
    query = F.regexp_extract(url, URL_PARTS, 4)
    pieces = F.filter(F.split(F.substring(query, F.lit(2), F.length(query)), "&"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            form_decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"),
            form_decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )


def last_param(pairs: Column, key: Column) -> Column:
    """Last value of a parameter, null when it is absent."""
    values = F.filter(pairs, lambda p: p["k"] == key)
    return F.get(values, F.size(values) - 1)["v"]


def optimize_list_url(url: Column, per_page: int = 100, current_page: Column | None = None) -> Column:
    """Set page size and page number on a list address; detail addresses pass through."""
    page = F.lit(None).cast("string") if current_page is None else current_page.cast("string")

    def rebuilt(pairs: Column) -> Column:
        keys = F.array_distinct(
            F.concat(F.transform(pairs, lambda p: p["k"]), F.array(F.lit("perPage"), F.lit("currentPage")))
        )
        def value(k: Column) -> Column:
            return (
                F.when(k == "perPage", F.lit(str(per_page)))
                .when((k == "currentPage") & page.isNotNull(), page)
                .otherwise(F.coalesce(last_param(pairs, k), F.lit("1")))
            )

        query = F.array_join(F.transform(keys, lambda k: F.concat(form_encode(k), F.lit("="), form_encode(value(k)))), "&")
        return F.concat(F.regexp_extract(url, r"^[^?#]*", 0), F.lit("?"), query, F.regexp_extract(url, "(#.*)?$", 0))

    return F.when((F.coalesce(url, F.lit("")) == "") | is_detail_url(url), url).otherwise(let(query_pairs(url), rebuilt))


def list_url(
    org: Column, page: Column, per_page: Column, portal_base: str, d_type: str = "FILE", sort: str = "updtDt"
) -> Column:
    """List address of one (organisation, page): every parameter, in the portal's order."""
    slots = {
        "{org}": form_encode(clean_text(org)),
        "{page}": page.cast("string"),
        "{per_page}": per_page.cast("string"),
        "{d_type}": F.lit(d_type),
        "{sort}": form_encode(F.lit(sort)),
    }
    parts = [F.concat(F.lit(k + "="), slots[v]) if v in slots else F.lit(f"{k}={v}") for k, v in V.LIST_PARAMS]
    return F.concat(F.lit(portal_base + V.LIST_PATH + "?"), F.concat_ws("&", *parts))


def org_from_url(url: Column) -> Column:
    """Organisation named by a list address, null when none of the three keys is filled."""
    return let(
        query_pairs(url),
        lambda p: F.coalesce(*[filled(last_param(p, F.lit(k))) for k in V.ORG_KEYS]),
    )


UrlBuilder = Callable[[Column, Column, Column], Column]
