"""Listing pages to cards, and the walk over pages as set queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import html as H
from ..functions import page_reader as R
from ..functions import text as X
from ..functions import tree as T
from ..functions import urls as U
from ..session import durable
from .numbering import number_rows

RESULT_LIST = H.class_tag("div", "result-list")
FILE_LIST = H.id_tag("fileDataList")
PAGINATION = rf"{H.class_tag('nav', 'pagination')}|{H.class_tag('div', 'pagination')}|{H.class_tag('[a-z]+', 'page')}"
CARD_KEYS = ["org", "page_no", "list_url"]


def _list_items(t: Column, open_tag: str) -> Column:
    """``li`` nodes inside a ``ul`` of every matching container, inner lists included."""
    boxes = T.outermost(T.matching(t, t["nodes"], open_tag))
    lists = F.flatten(F.transform(boxes, lambda b: T.outermost(T.tagged(T.below(t, b), "ul"))))
    return F.flatten(F.transform(lists, lambda u: T.tagged(T.below(t, u), "li")))


def _data_links(t: Column, nodes: Column) -> Column:
    """array<struct<node, href>> of the links among ``nodes`` whose raw address names a data page."""
    links = F.transform(T.tagged(nodes, "a"), lambda n: F.struct(n.alias("node"), H.attribute(T.start_tag(t, n), "href").alias("href")))
    return F.filter(links, lambda a: a["href"].contains("/data/") | a["href"].contains("/dataset/"))


def _title_node(t: Column, li: Column) -> Column:
    """``span.title`` of a card, else any ``.title``; null if it has none."""
    titled = T.matching(t, T.below(t, li), H.class_tag("[a-z][a-z0-9]*", "title"))
    return X.let(titled, lambda held: F.coalesce(F.get(T.tagged(held, "span"), F.lit(0)), F.get(held, F.lit(0))))


def _text_or_blank(t: Column, node: Column) -> Column:
    return X.let(node, lambda n: F.when(n.isNull(), "").otherwise(T.text_of(t, n)))


def _trees(pages: DataFrame) -> DataFrame:
    return pages.select(*CARD_KEYS, T.tree(H.visible(F.col("html"))).alias("tree"))


def cards(pages: DataFrame) -> DataFrame:
    """One row per dataset card (B1), or per data link on pages without cards (B2); read in the task that holds the page."""
    found = pages.select(*CARD_KEYS, R.listed(H.visible(F.col("html")), F.col("list_url")).alias("cards"))
    # Exploded as an expression: the optimizer would read the pages a second time to leave out those without cards.
    items = found.select(*CARD_KEYS, F.posexplode(F.transform("cards", lambda c: c)).alias("pos", "c"))
    names = ("raw_title", "title", "title_source", "formats", "views", "downloads", "detail_url")
    return items.select("org", "page_no", "pos", *[f"c.{n}" for n in names], F.col("list_url").alias("source_list_url"), *[f"c.{n}" for n in V.CARD_TARGETS])


def _simple_cards(pages: DataFrame, portal_base: str, with_file_list: bool) -> DataFrame:
    """Cards of the counts and download walks: the first data link of a card decides."""
    t = F.col("tree")

    def items() -> Column:
        main = _list_items(t, RESULT_LIST)
        if not with_file_list:
            return main
        return X.let(main, lambda m: F.when(F.size(m) > 0, m).otherwise(_list_items(t, FILE_LIST)))

    def linked(li: Column) -> Column:
        first = F.get(_data_links(t, T.below(t, li)), F.lit(0))
        return X.let(
            first, lambda a: F.struct(li.alias("li"), U.absolute_url(F.lit(portal_base), a["href"]).alias("url"), a["node"].alias("link"))
        )

    def usable(i: Column) -> Column:
        return (i["url"] != "") & U.is_counts_url(i["url"])

    def read(i: Column) -> Column:
        title = F.coalesce(_title_node(t, i["li"]), i["link"])
        return F.struct(i["url"].alias("url"), T.text_of(t, i["li"]).alias("text"), _text_or_blank(t, title).alias("raw_title"))

    found = _trees(pages).select(*CARD_KEYS, "tree", F.filter(F.transform(items(), linked), usable).alias("found"))
    rows = found.select(*CARD_KEYS, F.posexplode(F.transform("found", read)).alias("pos", "c"))
    return rows.select(*CARD_KEYS, "pos", "c.text", F.col("c.url").alias("detail_url"), "c.raw_title")


def counts_cards(pages: DataFrame, portal_base: str) -> DataFrame:
    """Title with view and download counts per card."""
    rows = _simple_cards(pages, portal_base, with_file_list=True).select(
        "org",
        "page_no",
        "pos",
        X.clean_dataset_title(F.col("raw_title"), unwrap=False).alias("title"),
        X.card_counts_int(F.col("text")).alias("counts"),
        "detail_url",
        "list_url",
    )
    return X.where_once(rows, lambda r: r["title"] != "").select(
        "org", "page_no", "pos", "title", "counts.views", "counts.downloads", "detail_url", "list_url"
    )


def download_cards(pages: DataFrame, portal_base: str) -> DataFrame:
    """Title and address per card, for the download list."""
    rows = _simple_cards(pages, portal_base, with_file_list=False)
    return rows.select(
        "org",
        "page_no",
        "pos",
        X.clean_filename(F.col("raw_title")).alias("title"),
        F.col("detail_url").alias("href"),
        F.col("list_url").alias("source_list_url"),
    )


def page_totals(pages: DataFrame, per_page: int = V.ORG_PAGE_SIZE) -> DataFrame:
    """Result count and page count announced by each listing page."""
    t = F.col("tree")
    base = _trees(pages).select("*", T.page_text(t).alias("text"))
    announced = X.first_filled(*[F.regexp_extract("text", X.rx(p), 1) for p in V.TOTAL_COUNT_PATTERNS])
    first = F.get(T.matching(t, t["nodes"], PAGINATION), F.lit(0))
    links = X.let(first, lambda n: F.when(n.isNotNull(), T.tagged(T.below(t, n), "a")))

    def numbers(n: Column) -> Column:
        clicks = H.attribute(T.start_tag(t, n), "onclick")
        shown = X.erase(T.text_of(t, n), r"\D")
        return F.concat(F.array(shown), F.regexp_extract_all(clicks, F.lit(X.rx(r"\d+")), F.lit(0)))

    pages_seen = F.array_max(F.transform(F.flatten(F.transform(links, numbers)), lambda n: n.try_cast("long")))
    has_item = (F.size(_list_items(t, RESULT_LIST)) > 0) | (F.size(_data_links(t, t["nodes"])) > 0)
    facts = base.select(
        *CARD_KEYS,
        F.coalesce(F.replace(announced, F.lit(",")).try_cast("long"), F.lit(0).cast("long")).alias("announced"),
        pages_seen.alias("pages_seen"),
        has_item.alias("has_item"),
    )
    count = (
        F.when(F.col("announced") > 0, F.col("announced"))
        .when(F.col("pages_seen").isNotNull(), F.col("pages_seen") * per_page)
        .when(F.col("has_item"), per_page)
        .otherwise(0)
    )
    total = (
        F.when(F.col("announced") > 0, F.ceil(F.col("announced") / per_page))
        .when(F.col("pages_seen").isNotNull(), F.col("pages_seen"))
        .when(F.col("has_item"), 1)
        .otherwise(0)
    )
    return facts.select(
        *CARD_KEYS, "announced", count.cast("long").alias("total_count"), total.cast("long").alias("total_pages")
    )


# --- the walk ------------------------------------------------------------------------
def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key; partial aggregation keeps a hot key from piling up in one task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def stop_pages(first: DataFrame, group: str = "org") -> DataFrame:
    """First page of each group that is missing, empty or brings nothing new.

    ``first`` holds one row per (group, address) with the page where it was first seen,
    so the pages present in it are exactly the pages that brought something new. The
    stop is the smallest page number not among them: an anti-join on (group, page).
    """
    fresh = first.select(group, F.col("page_no").cast("long").alias("page_no")).distinct()
    ahead = fresh.select(group, (F.col("page_no") + 1).alias("page_no"))
    start = first.select(group).distinct().select(group, F.lit(1).cast("long").alias("page_no"))
    return (
        ahead.unionByName(start)
        .join(fresh, [group, "page_no"], "left_anti")
        .groupBy(group)
        .agg(F.min("page_no").alias("stop_page"))
    )


def walk(first: DataFrame, group: str = "org") -> DataFrame:
    """Keep what a page-by-page walk would have reached.

    The first sightings are read four times (three for the stop pages), so they are cut here
    and the pages behind them are parsed once.
    """
    first = durable(first)
    stops = stop_pages(first, group)
    return first.join(stops, group).where(F.col("page_no") < F.col("stop_page")).drop("stop_page")


def cap_pages(pages: DataFrame, max_pages: int | Column) -> DataFrame:
    """Pages up to a cap, 0 meaning no cap (C4); applied before the walk."""
    cap = F.lit(max_pages) if isinstance(max_pages, int) else max_pages
    return pages.where((cap <= 0) | (F.col("page_no") <= cap))


def walk_page_cap(total_pages: Column) -> Column:
    """Pages to read for an organisation's detail list, from its 10-per-page total."""
    pages = F.when(F.coalesce(total_pages, F.lit(0)) == 0, 1).otherwise(total_pages)
    needed = F.ceil(pages * V.ORG_PAGE_SIZE / V.ORG_WALK_PAGE_SIZE)
    return (F.greatest(F.lit(1), needed) + V.ORG_WALK_EXTRA_PAGES).cast("long")


def report_page_cap(total_pages: Column) -> Column:
    """Pages to read for an organisation's metadata report; 0 (no cap) when it is empty."""
    rows = F.greatest(F.lit(0), F.coalesce(total_pages, F.lit(0)) * V.ORG_PAGE_SIZE)
    needed = F.greatest(F.lit(1), F.ceil(rows / V.ORG_REPORT_PAGE_SIZE) + V.ORG_REPORT_EXTRA_PAGES)
    return F.when(rows > 0, needed).otherwise(0).cast("long")


def number_items(items: DataFrame, within: tuple[str, ...] = (), order: tuple[str, ...] = ("page_no", "pos")) -> DataFrame:
    """Sequence numbers in crawl order."""
    return number_rows(items, order, "seq", within)


def cap_items(items: DataFrame, max_items: int, order: tuple[str, ...] = ("page_no", "pos")) -> DataFrame:
    """The first N items of one job in crawl order, 0 meaning all."""
    if max_items <= 0:
        return items
    return number_rows(items, order, "_n").where(F.col("_n") <= max_items).drop("_n")


def direct_items(targets: DataFrame) -> DataFrame:
    """A detail address given as the target becomes one item without a list walk."""
    blank = [F.lit("").alias(c) for c in ("raw_title", "title")]
    return targets.where(U.is_detail_url(F.col("target_url"))).select(
        "org",
        F.lit(1).alias("page_no"),
        F.lit(0).alias("pos"),
        *blank,
        F.lit("direct_url").alias("title_source"),
        *[F.lit("").alias(c) for c in ("formats", "views", "downloads")],
        F.col("target_url").alias("detail_url"),
        F.lit("").alias("source_list_url"),
        *[F.lit(None).cast("string").alias(c) for c in V.CARD_TARGETS],
    )


def resolve_orgs(inputs: DataFrame, org_counts: DataFrame, portal_base: str) -> DataFrame:
    """First spelling of each name that has pages, else the cleaned name with 0."""
    tried = inputs.select("user_input", F.posexplode(X.org_variations(F.col("user_input"))).alias("rank", "org_name"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total_count") / V.ORG_PAGE_SIZE)).cast("long")
    known = org_counts.where(F.col("total_count") > 0).select("org_name", "total_count", pages.alias("total_pages"))
    hits = tried.join(known, "org_name").groupBy("user_input").agg(
        F.min_by(F.struct("org_name", "total_count", "total_pages"), "rank").alias("hit")
    )
    name = F.coalesce("hit.org_name", X.clean_text(F.col("user_input")))
    found = inputs.distinct().join(hits, "user_input", "left").select(
        "user_input",
        name.alias("org_name"),
        F.coalesce("hit.total_count", F.lit(0).cast("long")).alias("total_count"),
        F.coalesce("hit.total_pages", F.lit(0).cast("long")).alias("total_pages"),
    )
    one = F.lit(1)
    return found.select(
        "*",
        U.list_url(F.col("org_name"), one, F.lit(10), portal_base, d_type="").alias("search_url"),
        U.list_url(F.col("org_name"), one, F.lit(100), portal_base).alias("file_list_url"),
    )
