"""Columns of the user that are called as a stage's own inner columns."""

import pytest
from pyspark.sql import functions as F

from folio_spark.llm import cgk_decontam, crf_language, line_dedup, poisson_mix, simhash, site_style

CLASHES = "_gone _doc _kept _lines _of _count _steps _draw _maybe _Slot _word _bits _lang_pred _lang_score _host _before leaked_items user_column_0".split()


def named(df):
    return df.select("*", *[F.lit(f"mine {i}").alias(c) for i, c in enumerate(CLASHES)])


STAGES = {
    "language": lambda d: crf_language.keep_identified(d, crf_language.fit(d)),
    "lines": line_dedup.keep_with_lines,
    "simhash": simhash.keep_one,
    "leaks": lambda d: cgk_decontam.without_leaks(d, d.sparkSession.createDataFrame([(1, "an item that is in no text")], "item_id long, text string")),
    "mix": lambda d: poisson_mix.replicate(d, size=3.0),
}


@pytest.mark.parametrize("stage", list(STAGES))
def test_stage_keeps_columns(documents, stage):
    docs = named(documents([(i, f"some words of text {i} and\nanother line of number {i * 7919}") for i in range(12)]))
    out = STAGES[stage](docs)
    assert [c for c in out.columns if c not in ("copy_no", "shuffle_key")] == docs.columns
    rows = out.collect()
    assert rows and all([r[c] for c in CLASHES] == [f"mine {i}" for i in range(len(CLASHES))] for r in rows)


def test_pages_keep_columns(spark):
    pages = [(i, f"http://h/{i}", f"<html><body><p>page {i} has words</p></body></html>") for i in range(8)]
    out = site_style.main_texts(named(spark.createDataFrame(pages, "page_id long, url string, html string")))
    rows = out.collect()
    assert len(rows) == 8 and all([r[c] for c in CLASHES] == [f"mine {i}" for i in range(len(CLASHES))] for r in rows)
