import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio_spark.llm import quality_rules as Q

STOPS = set(" ".join(Q.STOP_WORDS.values()).split())


def literal(text):
    """The measures by literal loops over one text."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(windows) if windows.count(g) > 1 for k in range(3)}
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines, dup = lines + 1, dup + (line in seen)
            seen.add(line)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_stop_words": sum(w.lower() in STOPS for w in words), "n_lines": lines, "n_dup_lines": dup, "n_repeat_words": len(covered),
    }


def judged(m):
    def breaks(r):
        value, unit = (m[r.numerator], 1) if r.denominator is None else (100 * m[r.numerator], m[r.denominator])
        return (r.low is not None and value < r.low * unit) or (r.high is not None and value > r.high * unit)

    return [r.name for r in Q.RULES if breaks(r)]


TEXTS = [
    None, "", "   \n\t \n", "the", "a b", "a b c", "a b c a b c", "a a a a a a", "x y z\nx y z\n\nx y z", "der und die " * 40, "***" * 60,
    "one two three \x0bfour\x0c five\r\nsix", "é# ü$ ö% |<>&", "Ciónarll la que\nde Ñ ÿ\nCiónarll la que", "word " * 30_000,
    " ".join(f"w{i}" for i in range(400)), "\n".join(f"the line of {i}" for i in range(60)), "\n".join(["the same line of words"] * 9),
]


def test_measures_and_verdicts(spark, documents):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "the"), (None, "a b c a b c")]
    docs = documents(rows).withColumnRenamed("score", "quality")
    got = Q.judge(docs).select("doc_id", "text", "quality.*").collect()
    assert len(got) == len(rows)
    for r in got:
        want = literal(r["text"]) if len(r["text"] or "") < 10_000 else None
        if want:
            assert {k: r[k] for k in Q.MEASURES} == want
            assert r["broken"] == judged(want)
        else:  # one word, repeated
            assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (30_000, 30_000, True)
        assert r["kept"] == (not r["broken"])
        assert r["base_failed"] == bool({"few_words", "repeated_words"} & set(r["broken"]))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#é\t", max_size=60), min_size=1, max_size=8))
def test_measures_of_any_text(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in Q.judge(docs).select("text", "quality.*").collect():
        assert {k: r[k] for k in Q.MEASURES} == literal(r["text"])


def test_empty_table_and_columns(spark, documents):
    docs = documents([(1, "x")]).limit(0)
    assert Q.op13_quality(docs).count() == 0
    assert Q.keep(docs).columns == docs.columns


def test_rules_are_data(spark, documents):
    table = spark.createDataFrame([("long", "n_words", None, 3, None, True), ("plain", "n_symbols", "n_words", None, 0, False)], "name string, numerator string, denominator string, low int, high int, base boolean")
    rules = Q.rules_of(table)
    kept = Q.keep(documents([(1, "a b c"), (2, "a b"), (3, "a b #"), (4, None)]), rules)
    assert [r["doc_id"] for r in kept.collect()] == [1]
    with pytest.raises(ValueError):
        Q.rules_of(table, most=1)
    with pytest.raises(ValueError):
        Q.keep(kept, [Q.Rule("none", "no_such", None, 1, None)])


def test_one_projection_without_user_functions(spark, sf_dir):
    plan = Q.op13_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_verdicts_follow_the_labels(spark):
    folder = "/root/testdata/sf0.01"
    judged = Q.op13_quality(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality"), "doc_id")
    rows = judged.where("quality = 0 or not base_failed").collect()
    assert all(r["kept"] == (r["quality"] == 1) for r in rows)
