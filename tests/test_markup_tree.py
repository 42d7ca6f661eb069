"""The stack of open elements at depth, its task function without the package, and page rules dealt over tasks."""

import subprocess
import sys
import time

import pyarrow as pa
import pytest
from pyspark import cloudpickle

from folio_spark.functions import markup_tree as K
from folio_spark.functions import text as X
from folio_spark.workloads import QUERIES


def test_deep_and_long_pages_take_time_in_proportion():
    deep = "<div>" * 200_000
    start = time.time()
    page = K.page_trees({})(pa.array([deep, "<p>a<b>b</p>" * 100_000])).to_pylist()
    assert time.time() - start < 20
    assert page[0]["nodes"][0] == {"at": 0, "tag": "div", "open": 0, "stop": 200_000, "last": 199_999, "parent": -1}
    assert len(page[1]["nodes"]) == 200_000 and page[1]["nodes"][2]["parent"] == -1


def test_odd_markup():
    named = {"amp": "&", "nbsp": " "}
    made = K.page_trees(named)(pa.array([None, "", "< a <3", "x&amp;nbsp;&#55296;&#xAC00;&odd;", "<scripts>a<SCRIPT x>b</script>"])).to_pylist()
    assert [m["text"] for m in made] == [[""], [""], ["< a <3"], ["x&nbsp;�가&odd;"], ["a", "", ""]]
    assert [n["tag"] for n in made[4]["nodes"]] == ["scripts", "script"]


def test_task_function_needs_no_package():
    code = "import sys, pickle, pyarrow as pa; print(len(pickle.loads(sys.stdin.buffer.read())(pa.array(['<p>a'])).to_pylist()[0]['nodes'])); assert 'folio_spark' not in sys.modules"
    run = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(K.page_trees({})), capture_output=True, cwd="/", check=True)
    assert run.stdout.strip() == b"1"


@pytest.mark.parametrize("name", ["b12_header_kinds", "b14_title_order", "b15_phone", "b13_nested_cells", "b14_nested_titles", "b15_nested_phone"])
def test_built_pages_are_dealt_over_tasks(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() > 1


def test_column_output_pages_are_dealt_over_tasks(spark, sf_dir):
    assert QUERIES["c13_c15_column_output"](spark, sf_dir).rdd.getNumPartitions() > 1


def test_tables_come_with_the_tree(monkeypatch):
    """Own cells, all below for rows of one, normal forms; the nodes of one order of tags are made once."""
    made = []
    shape_of = K.shape_of
    monkeypatch.setattr(K, "shape_of", lambda names: made.append(names) or shape_of(names))
    monkeypatch.setattr(K, "KNOWN", 3)
    rows = "<table><tr><th>a : {0}<td>b<table><tr><td>c &amp; <b>d</b> e</table>f<tr><td><table><tr><td>x<td>y</table></table>"
    found = K.page_trees({"amp": "&"}, "[ :]", ("tables",))(pa.array([rows.format(i) for i in range(5)])).to_pylist()
    assert len(made) == 1
    for i, page in enumerate(found):
        sides = [[tuple(None if r[n] is None else [c["text"] for c in r[n]] for n in ("cells", "paired")) for r in t] for t in page["tables"]]
        inner, two = (["c & d e"], ["c & d e"]), (["x", "y"], None)
        assert sides == [[([f"a : {i}", "b c & d e f"], None), inner, (["x y"], ["x y", "x", "y"]), two], [inner], [two]]
        assert page["tables"][0][0]["cells"][0] == {"tag": "th", "at": 2, "text": f"a : {i}", "key": f"a{i}"}


def test_cells_and_rows_are_marked(monkeypatch):
    """Bits of text, starts and groups per cell; any of a row's, and all that have a text (-1 without one); known from batch to batch."""
    run = K.page_trees({}, "[ :]", ("tables",), groups=(("a", "b"), ("b",)), starts="xy")
    html = "<table><tr><th>a :<td>b<td> <tr><tr><td> <td>:<tr><td>a<td>b<tr><td>0x<td></table>"
    for _ in range(2):
        rows = run(pa.array(["<p>", html])).to_pylist()[1]["tables"][0]
        assert [[c["mark"] for c in r["cells"]] for r in rows] == [[5, 13, 0], [], [0, 1], [5, 13], [3, 0]]
        assert [(r["any"], r["all"]) for r in rows] == [(13, 5), (0, -1), (1, 1), (13, 5), (3, 3)]
        monkeypatch.setattr(K, "token_reader", None)


@pytest.mark.parametrize("markup", ["", "a", "<p>a<b>", "x<p>a</p>", "a < b<p>", "<<p>< a", "<!-- --><?x?>", "<", "<p><"])
def test_tokens_of_tidy_and_of_odd_markup(markup):
    raw = K.TOKEN.findall(markup)
    first = K.FIRST.search(markup)
    head = markup if first is None else markup[: first.start()]
    assert K.raw_tokens(markup) == ([head] if head or first is None else []) + raw


def test_words_a_page_says():
    """Over tokens, as they stand or in capitals; every page has its own."""
    pages = ["<p>too many</p><p>requests csv", "", None, "<script>CSV</script>Too <b>Many", "captcha &amp; c"]
    made = K.page_trees({"amp": "&"}, " ", ("text", "said"), ("CSV", "many requests", "Too Many", "captcha & c"))(pa.array(pages)).to_pylist()
    assert [m["said"] for m in made] == [["CSV", "many requests"], [], [], ["Too Many"], ["captcha & c"]]


def test_white_space_spelled_out(spark):
    """The spelled-out classes hold what the Unicode class holds, for every character."""
    chars = spark.range(1, 0xD800).selectExpr("decode(encode(char(0), 'UTF-8'), 'UTF-8') AS z", "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c")
    spelled = rf"^[ {X.NOT_PLAIN}]$"
    assert chars.where(chars.c.rlike(spelled) != chars.c.rlike(X.rx(rf"^{X.WS}$"))).count() == 0
