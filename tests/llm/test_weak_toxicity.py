"""Weak supervision: estimates on votes of known origin, held-out quality, odd rows."""

import random

import numpy as np
import pytest

from folio_spark.llm import weak_toxicity as W


def test_label_model_recovers_rates_and_dependence():
    rng = np.random.default_rng(1)
    n = 4000
    y = rng.random(n) < 0.2
    rate = np.array([[0.02, 0.05, 0.03, 0.1], [0.6, 0.5, 0.4, 0.7]])
    fired = np.stack([rng.random(n) < rate[y.astype(int), j] for j in range(4)], axis=1)
    fired = np.concatenate([fired, fired[:, :1], fired[:, :1]], axis=1).astype(np.float32)  # two voters copy the first
    start = np.clip(np.where(y, 0.8, 0.2) + rng.normal(0, 0.1, n), 0.01, 0.99)
    post, found, depend = W.label_model(fired, 0.2, np.ones(n), start, 6)
    assert np.abs(found[:, :4] - rate).max() < 0.1
    assert depend[0] == pytest.approx(1 / 3, abs=0.05) and depend[1] == 1.0
    assert ((post > 0.5) == y).mean() > 0.9


def test_linear_model_learns_soft_labels():
    rows = [np.array([0]), np.array([1]), np.array([0, 1]), np.array([], np.int64)] * 50
    target = np.array([0.9, 0.1, 0.5, 0.5] * 50)
    w = W.linear_model(rows, 2, target, np.ones(200))
    assert w[0] == pytest.approx(-w[1], abs=0.05) and w[0] > 1.5 and abs(w[2]) < 0.05


def test_terms():
    assert W.terms_of("word") == ["=word"] and set(W.terms_of("slurring")) == {"=slurring", "slur-", "slurr-", "slurri-", "-ring", "-rring"}
    assert W.styles("LOUD TEXT")[0] and not W.styles("quiet")[0] and W.styles(None)[3]


def corpus(n=900):
    rng = random.Random(8)
    plain = ["river", "stone", "garden", "window", "market", "paper", "wheel", "north"]
    bad = ["scumbag", "idiotic", "wretchful", "wretcher", "wretchy"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        words = rng.choices(plain, k=rng.randrange(3, 40)) + (rng.sample(bad, 2) if toxic else [])
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out(spark, documents):
    docs, labels = corpus()
    table = spark.createDataFrame([(i, 1, t, "x") for i, t in labels] + [(None, 0, 1, "x"), (3, 0, None, "x"), (10**9, 0, 1, "x")], "doc_id long, quality int, toxic int, text string")
    out = W.op8_toxicity(documents([*docs, (5000, None), (5001, ""), (None, "scumbag idiotic wretcher"), (5002, "wretchish scumbag " * 4000)]), table).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 904 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    held = [(got[i].predicted, t) for i, t in labels if got[i].held_out]
    assert np.mean([p == t for p, t in held]) > 0.98
    assert got[5000].score == got[5001].score < 0.5 and got[None].held_out and got[None].predicted == 1 and got[5002].predicted == 1


def test_repeated_rows_get_equal_scores(spark, documents):
    docs, labels = corpus(200)
    table = spark.createDataFrame(labels + labels, "doc_id long, toxic int")
    out = W.op8_toxicity(documents(docs + docs[:50]), table).collect()
    assert len(out) == 250 and all(len({r.score for r in out if r.doc_id == i}) == 1 for i in range(50))


def test_nothing_to_learn(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert W.op8_toxicity(documents([]), none).count() == 0
    assert W.op8_toxicity(documents([(1, "text")]), none).first().predicted == 0
    clean = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, toxic int")
    assert W.op8_toxicity(documents([(1, "text")]), clean).first().score < 0.01


def test_shipped_labels(spark, sf_dir):
    base = f"{sf_dir.rsplit('/', 1)[0]}/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    held = W.op8_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r.score for r in held if r.toxic], np.array([r.score for r in held if not r.toxic])
    assert np.mean([(clean < s).mean() for s in toxic]) > 0.95  # area under the curve
    assert np.mean([r.toxic for r in held if r.predicted]) > 0.9
