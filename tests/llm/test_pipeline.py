"""The pipeline's stages, one after the other, each against what its input calls for."""

import corpus_pipeline as P
from folio_spark.llm import cgk_decontam, line_dedup, simhash

from .test_cgk_decontam import brute_force as leaked
from .test_line_dedup import brute_force as deduped


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    seen = []
    for name, stage in P.STAGES:
        before = docs.collect()
        docs = P.cut(stage(spark, docs, sf_dir), name)
        after = docs.collect()
        seen.append(name)
        assert docs.columns[: len(columns)] == columns and len(after) > 0
        if name == "language_id":
            assert {r.doc_id for r in after} == {r.doc_id for r in before if any(c.isalpha() for c in r.text)}
        elif name == "line_dedup":
            # Lines of the smallest documents only: all pairs of lines are quadratic.
            some = sorted(before, key=lambda r: r.n_chars)[:60]
            want = dict(deduped([(r.doc_id, r.text) for r in some]))
            got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(some)).collect()}
            assert got == want
            assert {r.doc_id for r in after} <= {r.doc_id for r in before} and all(r.n_chars == len(r.text) and r.text.strip() for r in after)
        elif name == "simhash_dedup":
            groups = {}
            for r in simhash.op5_simhash(spark.createDataFrame(before)).collect():
                groups.setdefault(r.component_id, set()).add(r.doc_id)
            assert {r.doc_id for r in after} == {min(g) for g in groups.values()}
        elif name == "decontaminate":
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            exact = {r.doc_id for r in before if any(t in r.text for _, t in items)}
            assert exact <= gone and all(leaked(r.text, items) for r in before if r.doc_id in gone)
        else:
            assert {r.doc_id for r in after} <= {r.doc_id for r in before} and {"copy_no", "shuffle_key"} <= set(docs.columns)
    assert seen == [name for name, _ in P.STAGES] and cgk_decontam.MIN_WORDS == 5


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = P.cut(stage(spark, docs, sf_dir), "empty")
        assert docs.count() == 0


def test_odd_rows(documents, sf_dir, spark):
    docs = documents([(1, None), (2, ""), (None, "a text without id"), (3, "the same text"), (3, "the same text"), (4, "12 34 !!"), (5, "word " * 9000)]).drop("line", "score")
    for _, stage in P.STAGES:
        docs = P.cut(stage(spark, docs, sf_dir), "odd")
    assert {r.doc_id for r in docs.collect()} <= {None, 3, 5}
