"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged by the path of their elements. Each merged node has an
importance between 0 and 1: the entropy of its presentation (how differently its children are laid
out over the pages) and of its content (a text that many pages share says little). Branches of low
importance are template and are removed from each page, as are branches that by element or name
are no article text (menus, headers, footers, forms, comments and the like).

Copies of a page's content count once per host, whatever task reads them. Merging is a count by
(host, path, feature), combined inside each task first, so a host with a third of all pages shuffles
no more rows per task than a small one.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, own_names

CONTENT_WEIGHT = 0.9  # of content against presentation in a node's importance
LOW = 0.4  # importance below which a branch is template
LEAST_PAGES = 5  # different pages that must have a node before it is judged

TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|[!?/][^>]*>)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")

# Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())  # their content is no markup
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr li dd dt".split())
SIBLINGS = {  # a start tag ends an open element of these names inside the given containers
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NEVER = frozenset(
    "script style noscript template nav footer aside form button select input textarea label fieldset svg canvas iframe object embed "
    "audio video map menu dialog head title".split()
)
# Parts of class, id and role names that mark a branch as no article text.
NAMED_AWAY = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie "
    "cookies copyright disclaimer disqus footer form gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification "
    "overlay pager pagination popup promo promotion promoted recommended recommendations related replies respond search share sharing sidebar signup "
    "social sponsor sponsored subscribe subscription teaser toc toolbar widget widgets complementary contentinfo".split()
)
NAMED_HEADER = frozenset("header topbar top sitehead".split())  # only outside the article
REGION_NAMES = frozenset("article articlebody story post entry content main".split())


class Node:
    __slots__ = ("tag", "path", "kids", "away", "region", "texts", "parent")

    def __init__(self, tag: str, path: int, away: bool, region: int, parent: Node | None):
        self.tag, self.path, self.away, self.region, self.parent = tag, path, away, region, parent
        self.kids: list[str] = []
        self.texts: list[int] = []  # numbers of the blocks below


def _hash(*parts) -> int:
    import xxhash

    v = xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return v - (1 << 64) if v >> 63 else v


def _named(attrs: str) -> tuple[str, frozenset, bool, str]:
    """(class and id without digits, parts of the names, hidden, role) of a start tag."""
    if not attrs.strip():
        return "", frozenset(), False, ""
    found = {}
    for m in ATTRIBUTE.finditer(attrs):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = " ".join(found.get(k, "") for k in ("class", "id", "role", "itemprop")).strip()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    own = DIGITS.sub("", f"{found.get('class', '')}#{found.get('id', '')}")
    return own, frozenset(p.lower() for p in NAME_PART.findall(names)), hidden, found.get("role", "").lower()


def parse(html: str, known: dict) -> tuple[list[Node], list[tuple[str, Node]]]:
    """Elements in page order and text blocks (white space collapsed, element they stand in).

    Forgiving: unclosed and crossed elements end where HTML ends them, a cut-off page ends all.
    ``known`` holds start tags and paths already read, from page to page of a batch.
    """
    root = Node("#", 0, False, 0, None)
    nodes, blocks, stack, run = [root], [], [root], []

    def flush():
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                node = stack[-1]
                while node.parent is not None and node.tag not in BLOCK:
                    node = node.parent
                number = len(blocks)
                blocks.append((text, node))
                while node is not None:
                    node.texts.append(number)
                    node = node.parent

    def pop_to(depth: int):
        if any(n.tag in BLOCK for n in stack[depth:]):
            flush()
        del stack[depth:]

    def close_in(names, containers):
        for d in range(len(stack) - 1, 0, -1):
            if stack[d].tag in names:
                pop_to(d)
                return
            if stack[d].tag in containers:
                return

    at, end = 0, len(html)
    for m in iter(lambda: TAG.search(html, at), None):
        if m.start() > at:
            piece = html[at : m.start()]
            run.append(unescape(piece) if "&" in piece else piece)
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag == name:
                    pop_to(d)
                    break
            continue
        if name == "br" or name == "wbr":
            if name == "br":
                run.append(" ")
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES_P:
                close_in({"p"}, {"table", "td", "th", "button", "caption"})
        if name in SIBLINGS:
            close_in(*SIBLINGS[name])
        parent = stack[-1]
        parent.kids.append(name)
        if name in VOID:
            continue
        attrs = m["attrs"]
        if (named := known.get(attrs)) is None:
            named = known[attrs] = _named(attrs)
        own, parts, hidden, role = named
        inside = parent.region
        if name == "article" or "articlebody" in parts or ("article" in parts and "body" in parts):
            region = 3
        elif name == "main" or role == "main":
            region = max(inside, 2)
        else:
            region = max(inside, 1 if parts & REGION_NAMES else 0)
        away = parent.away or hidden or name in NEVER or bool(parts & NAMED_AWAY) and name not in ("html", "body", "article", "main")
        away = away or name == "article" and bool(parts & {"comment", "related", "teaser", "promo"})
        away = away or inside < 3 and (name == "header" or bool(parts & NAMED_HEADER) and name not in ("html", "body", "h1", "article", "main"))
        step = (parent.path, name, own)
        if (path := known.get(step)) is None:
            path = known[step] = _hash(*step)
        node = Node(name, path, away, region, parent)
        nodes.append(node)
        if name in RAW:
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        stack.append(node)
    if at < end:
        piece = html[at:]
        run.append(unescape(piece) if "&" in piece else piece)
    flush()
    return nodes, blocks


def main_text(html: str | None, low: frozenset[int] | set[int] = frozenset(), known: dict | None = None) -> str:
    """Blocks of the page's article, one a line; ``low`` are paths of low importance on its host.

    Where the page marks an article (or main part, or names one) only text inside it counts. Low
    branches stay if they hold more than half of what is left, so that many copies of one article
    on a host do not remove each other.
    """
    nodes, blocks = parse(html or "", {} if known is None else known)
    kept = [(text, node) for text, node in blocks if not node.away]
    level = max((node.region for _, node in kept), default=0)
    kept = [(text, node) for text, node in kept if node.region >= level]
    if low and kept:

        def template(node: Node | None) -> bool:
            while node is not None:
                if node.path in low:
                    return True
                node = node.parent
            return False

        left = [(text, node) for text, node in kept if not template(node)]
        if 2 * sum(len(text) for text, _ in left) >= sum(len(text) for text, _ in kept):
            kept = left
    return "\n".join(text for text, _ in kept)


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


LAYOUT, TEXT, PAGES = 0, 1, 2


def _contents(batches):
    """Of each page its host, the hash of its text blocks in order, of its markup, and its nodes with text, packed."""
    for batch in batches:
        hosts, contents, pages, packed, known = [], [], [], [], {}
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            nodes, blocks = parse(html or "", known)
            names, nodes = [_hash(text) for text, _ in blocks], [n for n in nodes if n.texts]
            hosts.append(_hash(host_of(url)))
            contents.append(_hash(*names))
            pages.append(_hash(html or ""))
            counts = [len(nodes), *(len(n.texts) for n in nodes), *(t for n in nodes for t in n.texts)]
            hashes = [*(n.path for n in nodes), *(_hash(*n.kids) for n in nodes), *names]
            packed.append(np.array(counts, np.uint32).tobytes() + np.array(hashes, np.int64).tobytes())
        columns = [*(pa.array(c, pa.int64()) for c in (hosts, contents, pages)), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["host", "content", "page", "nodes"])


def _unpacked(packed: bytes) -> list[tuple[int, int, list[int]]]:
    """(path, layout, texts) of a page's nodes."""
    n = int(np.frombuffer(packed, np.uint32, 1)[0])
    length = np.frombuffer(packed, np.uint32, n, 4).tolist()
    at = np.frombuffer(packed, np.uint32, sum(length), 4 * (n + 1)).tolist()
    hashes = np.frombuffer(packed[4 * (1 + n + len(at)) :], np.int64).tolist()
    paths, layouts, names = hashes[:n], hashes[n : 2 * n], hashes[2 * n :]
    out, done = [], 0
    for path, layout, some in zip(paths, layouts, length):
        out.append((path, layout, [names[t] for t in at[done : done + some]]))
        done += some
    return out


def _features(batches):
    for batch in batches:
        counts: Counter = Counter()
        for host, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            of_page = set()
            for path, layout, texts in _unpacked(packed):
                of_page.add((host, path, PAGES, 0))
                of_page.add((host, path, LAYOUT, layout))
                of_page.update((host, path, TEXT, t) for t in texts)
            counts.update(of_page)
        columns = list(zip(*counts)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(list(counts.values()), pa.int64())], ["host", "path", "kind", "feature", "pages"]
        )


def importance(pages: DataFrame) -> DataFrame:
    """(host, path, n_pages, importance) of the merged nodes that have text, hosts and paths hashed.

    With m pages, a layout that n of them use has p = n / m and adds -p log_m p; a text on n pages
    has the entropy log_m n, which is averaged over the node's texts. Nodes of one page have 1.
    Pages of a host with the same text blocks in the same order are copies and count as one, the one
    with the lowest hash of its markup, wherever in the table they are.
    """
    contents = pages.select("url", "html").mapInArrow(_contents, "host long, content long, page long, nodes binary")
    once = contents.groupBy("host", "content").agg(F.min_by("nodes", "page").alias("nodes")).select("host", "nodes")
    raw = once.mapInArrow(_features, "host long, path long, kind int, feature long, pages long")
    counts = cut(raw.groupBy("host", "path", "kind", "feature").agg(F.sum("pages").alias("n")), "style-features")
    nodes = counts.where(F.col("kind") == PAGES).select("host", "path", F.col("n").alias("m"))
    used = counts.where((F.col("kind") != PAGES)).join(nodes, ["host", "path"])
    p = F.col("n") / F.col("m")
    log_m = F.log(F.greatest(F.col("m"), F.lit(2)))
    used = used.groupBy("host", "path", "m").agg(
        F.sum(F.when(F.col("kind") == LAYOUT, -p * F.log(p) / log_m).otherwise(0.0)).alias("layout"),
        (F.sum(F.when(F.col("kind") == TEXT, F.col("n") * F.log("n") / log_m)) / F.sum(F.when(F.col("kind") == TEXT, F.col("n")))).alias("shared"),
    )
    of_many = (1 - CONTENT_WEIGHT) * F.col("layout") + CONTENT_WEIGHT * (1 - F.coalesce("shared", F.lit(0.0)))
    return used.select("host", "path", F.col("m").alias("n_pages"), F.when(F.col("m") > 1, of_many).otherwise(F.lit(1.0)).alias("importance"))


def _extract(html_at: int, low_at: int):
    def run(batches):
        for batch in batches:
            html, low = batch.column(html_at).to_pylist(), batch.column(low_at).to_pylist()
            known: dict = {}
            texts = [main_text(h, set(x or ()), known) for h, x in zip(html, low)]
            columns = [*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "text", "n_chars"])

    return run


def _hosts(urls):
    for batch in urls:
        columns = [*batch.columns, pa.array([_hash(host_of(u)) for u in batch.column(batch.schema.get_field_index("url")).to_pylist()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_host"])


@own_names
def main_texts(pages: DataFrame, low: float = LOW, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` with ``text`` (empty if none) and ``n_chars``, its code points; all rows and columns stay.

    Null markup is empty; a null url, or one without host, belongs to the host of no name.
    Repeated pages get equal texts. Columns of the two names are replaced.
    """
    template = importance(pages).where((F.col("importance") < low) & (F.col("n_pages") >= least_pages))
    # Per host only the recurring nodes of its templates: bounded by its layouts, not by its pages.
    by_host = cut(template.groupBy(F.col("host").alias("_of")).agg(F.collect_set("path").alias("_low")), "low-branches")
    rows = pages.drop("text", "n_chars")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    named = rows.mapInArrow(_hosts, f"{fields}, _host long")
    held = named.join(by_host, named["_host"] == by_host["_of"], "left").drop("_host", "_of")
    schema = f"{fields}, _low array<bigint>, text string, n_chars long"
    return held.mapInArrow(_extract(rows.columns.index("html"), len(rows.columns)), schema).drop("_low")


def op2_main_text(pages: DataFrame) -> DataFrame:
    return main_texts(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
