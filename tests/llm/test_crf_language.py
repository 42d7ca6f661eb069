"""CRF language identification: exact inference, held-out accuracy, code-switched words."""

import itertools
import math

import numpy as np
import pytest

from folio_spark.llm import crf_language as C


@pytest.fixture(scope="module")
def learnt(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    return docs, C.fit(docs, docs_per_language=150, epochs=30)


def test_posteriors_by_enumeration():
    rng = np.random.default_rng(3)
    k, n = 3, 11
    m = C.Model(list("abc"), None, None, rng.normal(size=k), rng.normal(size=(k, k)), None, None)
    emit, opens = rng.normal(size=(n, k)), np.zeros(n, bool)
    opens[[0, 4, 5]] = True
    want = np.zeros((n, k))
    for a, b in ((0, 4), (4, 5), (5, 11)):
        for way in itertools.product(range(k), repeat=b - a):
            score = m.start[way[0]] + sum(emit[a + i, x] for i, x in enumerate(way)) + sum(m.transition[x, y] for x, y in zip(way, way[1:]))
            for i, x in enumerate(way):
                want[a + i, x] += math.exp(score)
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(C.posteriors(emit, opens, m), want)


def test_words_and_hashes():
    w = C.Words(["ab cd'ab", "", "é́x 12 ab"], C.letters())
    assert np.diff(w.of_text).tolist() == [3, 0, 2] and len(w) == 5
    h = w.hashes()
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3
    rows, of_word = w.grams(2)
    assert np.bincount(of_word).tolist() == [3, 3, 3, 4, 3]  # length + 1 pairs with both bounds


def test_held_out_accuracy(learnt):
    docs, m = learnt
    held = docs.where("crc32(cast(doc_id as string)) % 5 = 0").collect()
    names, scores = C.predict([r.text for r in held], m, C.letters())
    assert np.mean([n == r.lang for n, r in zip(names, held)]) > 0.98 and all(0 <= s <= 1 for s in scores)


def test_code_switched_words(learnt):
    """Inside one text the words of each part get that part's language."""
    docs, m = learnt
    held = {r.lang: r.text for r in docs.where("crc32(cast(doc_id as string)) % 5 = 0 and length(text) > 600").collect()}
    parts = [(lang, " ".join(held[lang].lower().split()[:30])) for lang in m.languages]
    words = C.Words([" ".join(p for _, p in parts)], C.letters())
    opens = np.zeros(len(words), bool)
    opens[0] = True
    best = C.posteriors(C.emissions(words, m), opens, m).argmax(axis=1)
    truth = [m.languages.index(lang) for lang, p in parts for _ in range(len(C.Words([p], C.letters())))]
    assert np.mean(best == truth) > 0.9


def test_pieces_do_not_matter(learnt, monkeypatch):
    docs, m = learnt
    texts = [r.text for r in docs.limit(30).collect()] + ["", None, "1234 !!", "x" * 5000]
    whole = C.predict(texts, m, C.letters())
    monkeypatch.setattr(C, "BLOCK", 500)
    monkeypatch.setattr(C, "CHAIN", 5000)
    small = C.predict(texts, m, C.letters())
    assert whole[0] == small[0] and np.allclose(whole[1], small[1])
    assert whole[0][30:33] == [C.UNKNOWN] * 3 and whole[1][30:33] == [0.0] * 3


def test_query_rows(documents):
    rows = [(i, "the house and the garden of the king") for i in range(30)] + [(None, "the house"), (7, "the house"), (40, None), (41, "12")]
    out = C.op4_language(documents(rows)).collect()
    assert len(out) == 34 and {r.lang_pred for r in out if r.doc_id not in (40, 41)} == {"en"} and all(r.held_out for r in out if r.doc_id is None)
    assert {r.lang_pred for r in out if r.doc_id in (40, 41) and r.score == 0} == {"und"}


def test_stage_keeps_columns(documents):
    docs = documents([(1, "the house and the garden"), (2, None), (3, "..."), (4, "the garden of the king")])
    kept = C.keep_identified(docs, C.fit(docs))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 4}


def test_nothing_to_learn(documents):
    assert C.op4_language(documents([])).count() == 0
    r = C.op4_language(documents([(1, "some text")], lang=None)).first()
    assert r.lang_pred == C.UNKNOWN and r.score == 0.0
