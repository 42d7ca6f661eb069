"""The page walk and numbering against literal loops over random inputs."""

import random

from pyspark.sql import functions as F

from folio_spark.operators import listing as L
from folio_spark.operators.numbering import number_rows, running


def literal_walk(pages):
    """Visit pages 1, 2, ... until one is missing, empty, repeated or brings nothing new."""
    seen, signatures, kept = set(), set(), []
    page = 1
    while True:
        urls = pages.get(page)
        if not urls or tuple(urls) in signatures:
            return kept
        signatures.add(tuple(urls))
        fresh = [u for u in dict.fromkeys(urls) if u not in seen]
        if not fresh:
            return kept
        seen.update(fresh)
        kept += [(u, page) for u in fresh]
        page += 1


def test_walk_matches_loop(spark):
    rng = random.Random(7)
    rows, want = [], set()
    cases = {
        "c1": {1: list("ab"), 2: list("bc"), 3: list("ac"), 4: list("z")},
        "c2": {1: list("a"), 2: [], 3: list("b")},
        "c3": {1: list("a"), 2: list("a"), 3: list("b")},
        "c4": {2: list("a")},
    }
    for i in range(400):
        n = rng.randint(1, 6)
        cases[f"r{i}"] = {p: [rng.choice("abcdefgh") for _ in range(rng.randint(0, 3))] for p in range(1, n + 1) if rng.random() > 0.1}
    for org, pages in cases.items():
        want |= {(org, u, p) for u, p in literal_walk(pages)}
        rows += [(org, p, i, u) for p, urls in pages.items() for i, u in enumerate(urls)]
    cards = spark.createDataFrame(rows, "org string, page_no int, pos int, detail_url string")
    first = L.keep_first(cards, ["org", "detail_url"], ["page_no", "pos"])
    got = {(r.org, r.detail_url, r.page_no) for r in L.walk(first).collect()}
    assert got == want


def test_walk_with_page_cap(spark):
    cards = spark.createDataFrame([("o", 1, 0, "a"), ("o", 2, 0, "b")], "org string, page_no int, pos int, detail_url string")
    first = L.keep_first(L.cap_pages(cards, 1), ["org", "detail_url"], ["page_no", "pos"])
    assert [r.detail_url for r in L.walk(first).collect()] == ["a"]


def test_page_caps(spark):
    df = spark.createDataFrame([(0,), (1,), (25,), (250,)], "n long")
    got = df.select(L.walk_page_cap(F.col("n")), L.report_page_cap(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(6, 0), (6, 3), (8, 3), (30, 5)]


def test_number_rows_with_hot_and_null_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", None, "a", "b"]), i, rng.random()) for i in rng.sample(range(5000), 3000)]
    df = spark.createDataFrame(rows, "g string, k int, v double").repartition(7)
    got = {r.k: (r.n, r.m) for r in number_rows(number_rows(df, ["k"], "n"), ["k"], "m", within=["g"]).collect()}
    want, counts = {}, {}
    for n, (g, k, _) in enumerate(sorted(rows, key=lambda r: r[1]), 1):
        counts[g] = counts.get(g, 0) + 1
        want[k] = (n, counts[g])
    assert got == want


def test_running_values_across_slices(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", None, "a"]), i, rng.choice([None, 1, 5, -2]), rng.choice([None, "x", "y"])) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k int, v long, s string").repartition(5)
    got = running(df, ["g"], ["k"], sums={"t": F.col("v")}, maxes={"m": F.col("v")}, lasts={"l": F.col("s")}).collect()
    state, want = {}, {}
    for g, k, v, s in rows:
        t, m, last = state.get(g, (0, None, None))
        t, m, last = t + (v or 0), m if v is None else v if m is None else max(m, v), last if s is None else s
        state[g] = (t, m, last)
        want[k] = state[g]
    assert {r.k: (r.t, r.m, r.l) for r in got} == want


def test_item_cap_takes_the_first_in_order(spark):
    items = spark.range(50).select((F.col("id") % 7).alias("page_no"), F.col("id").alias("pos"))
    first = sorted((i % 7, i) for i in range(50))[:9]
    assert sorted((r.page_no, r.pos) for r in L.cap_items(items, 9).collect()) == first
    assert L.cap_items(items, 0).count() == 50


def test_error_page_ends_counts_walk(spark):
    from folio_spark.plans.counts import org_counts_report

    page = '<div class="result-list"><ul><li><a href="/data/{n}/fileData.do">도로_{n}</a></li></ul></div>'
    rows = [("o", n, "l", 500 if n == 2 else 200, page.replace("{n}", str(n))) for n in (1, 2, 3)]
    pages = spark.createDataFrame(rows, "org string, page_no int, list_url string, status int, html string")
    assert [r.title for r in org_counts_report(pages, "https://portal.example").collect()] == ["도로_1"]
