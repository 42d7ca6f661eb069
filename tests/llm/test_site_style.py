"""Main text of pages."""

from folio_spark.llm import site_style as S

from .conftest import rows_of

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a='<p>no</p>';</script></head><body class='page'>"
    "<header class=top><h1>Site</h1></header><nav><ul><li>Home<li>News</ul></nav><!-- <p>hidden</p> --><div class='ad-box'>Buy</div>"
    "<article><header><h1>Title &amp; more</h1></header><p>First <b>bold\n text</b>&nbsp;here.<br>After<p>Second, unclosed"
    "<div class='share-links'>Share me</div><ul><li>one<li>two</ul><form><p>mail</p><input></form>"
    "<table><tr><td>a<td>b<tr><td>c</table><pre>x\n  y</pre></article>"
    "<aside>side</aside><section id='comments'><p>reader says</p></section><footer>&copy; me</footer>"
)


def test_article_only():
    assert S.main_text(PAGE) == "Title & more\nFirst bold text here. After\nSecond, unclosed\none\ntwo\na\nb\nc\nx y"


def test_cut_off_and_odd_pages():
    assert S.main_text(None) == S.main_text("") == S.main_text("<script>only") == S.main_text("<!-- open") == ""
    assert S.main_text("just text  here") == "just text here"
    assert S.main_text("<p>a < b &am") == "a < b &am"
    assert S.main_text("<main><p>x</p></main><p>outside</p>") == "x"
    assert S.main_text("<div class='post-content'><p>x</p></div><div>outside</div>") == "x"
    assert S.main_text("<body><p hidden>no</p><p style='display: none'>no</p><p>yes</p>") == "yes"
    assert S.main_text("<p title='a>b'>in</p></b></p>") == "in"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert S.main_text(deep) == "deep"


def test_template_without_names_is_found_by_importance(spark):
    """Blocks that no name gives away are removed because the host's pages share them."""
    page = "<html><body><div class='kx'><p>Follow our channel</p><p>Today only</p></div><div class='ky'><p>Story {0} of its own</p><p>And {0} more words</p></div></body></html>"
    rows = [(i, f"https://www.host.example/p/{i}", page.format(i)) for i in range(40)]
    rows += [(100, "https://small.example/x", page.format(7)), (101, None, None), (102, "not a url", "<p>t</p>"), (103, "https://www.host.example/p/1", page.format(1))]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string").repartition(4)
    got = {r.page_id: r for r in S.main_texts(pages).collect()}
    assert len(got) == 44
    for i in range(40):
        assert got[i].text == f"Story {i} of its own\nAnd {i} more words" and got[i].n_chars == len(got[i].text)
    assert got[100].text.startswith("Follow our channel")  # one page shows no template
    assert got[101].text == "" and got[101].n_chars == 0 and got[102].text == "t" and got[103].text == got[1].text


def test_importance_by_hand(spark):
    page = "<body><div class='a'><p>same</p></div><div class='b'><p>own {0}</p></div></body>"
    pages = spark.createDataFrame([(f"http://h/{i}", page.format(i)) for i in range(8)], "url string, html string")
    found = {r.importance for r in S.importance(pages).collect()}
    # Shared: layout 0 and content 1 - log_8 8 = 0; own: content 1; above both: half of each.
    assert {round(x, 6) for x in found} == {0.0, round(S.CONTENT_WEIGHT, 6), round(S.CONTENT_WEIGHT * 0.5, 6)}


def test_copies_do_not_remove_each_other(spark):
    page = "<body><div class='c'><p>One story that was copied</p><p>over and over {0}</p></div></body>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", page.format(i % 2)) for i in range(30)], "page_id long, url string, html string")
    assert all(r.text.startswith("One story") for r in S.main_texts(pages).collect())


def test_empty_table(spark):
    assert S.op2_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_shipped_pages(spark, sf_dir):
    """The article of the shipped pages, cut out with plain patterns."""
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    plain = {}
    for r in pages.collect():
        found = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)
        parts = re.split(r"</?(?:p|h1)>", found[1] if found else "")
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts]
        plain[r.page_id] = "\n".join(x for x in texts if x)
    assert rows_of(S.op2_main_text(pages), "page_id", "text") == sorted(plain.items(), key=repr)


def test_copies_count_once_however_the_table_is_split(spark):
    """Copies that differ in a comment and a script only, in many partitions, change no count."""

    def page(i, copy=0):
        return (f"https://h.example/{i}/{copy}", f"<!-- {copy} --><body><script>n={copy}</script><div class=n>Same</div><div class=b><p>Text {i} of its own.</p></div>")

    def merged(rows, parts):
        return rows_of(S.importance(spark.createDataFrame(rows, "url string, html string").repartition(parts)), "*")

    once = [page(i) for i in range(6)]
    copies = [page(0, k) for k in range(1, 40)] + [page(1)] * 5
    want = merged(once, 1)
    assert {r[2] for r in want} == {6}
    assert merged(once + copies, 1) == want and merged(once + copies, 9) == want
