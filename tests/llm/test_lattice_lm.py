"""Lattice likelihood against enumerated segmentations and counted words."""

import math
import random
import zlib

import pytest

from folio_spark.llm import lattice_lm as L


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


def test_forward_sums_all_segmentations(monkeypatch):
    rng = random.Random(4)
    pieces = {b"\0", b"a", b"b", b"\0a", b"ab", b"ba", b"\0ab", b"aba", b"bb", b"abab"}
    logs = {p: math.log(rng.uniform(0.01, 0.3)) for p in pieces}
    root = L.trie(logs)
    for word in (b"", b"a", b"ab", b"abab", b"bbabaab"):
        want = sum(math.exp(sum(logs[p] for p in s)) for s in segmentations(b"\0" + word, pieces))
        assert L.forward(b"\0" + word, root)[0][-1] == pytest.approx(math.log(want))
        plain, logs_only = [0.0] * len(logs), [0.0] * len(logs)
        L.expected(b"\0" + word, root, plain)
        monkeypatch.setattr(L, "PLAIN", 0)
        L.expected(b"\0" + word, root, logs_only)
        monkeypatch.undo()
        uses = {}
        for s in segmentations(b"\0" + word, pieces):
            for p in s:
                uses[p] = uses.get(p, 0) + math.exp(sum(logs[q] for q in s)) / want
        for totals in (plain, logs_only):
            assert {p: n for p, n in zip(logs, totals) if n} == pytest.approx(uses)


def test_long_words_do_not_underflow():
    root = L.trie({b"\0": math.log(0.5), b"a": math.log(1e-6)})
    assert L.forward(b"\0" + b"a" * 50_000, root)[0][-1] == pytest.approx(math.log(0.5) + 50_000 * math.log(1e-6))


def test_vocabulary_is_a_distribution():
    pieces = L.vocabulary()
    assert sum(v for k, v in pieces.items() if k[:1] == b"\0") == pytest.approx(1)
    assert sum(v for k, v in pieces.items() if k[:1] != b"\0") == pytest.approx(1)
    assert all(bytes([b]) in pieces for b in range(256)) and not any(b"\0" in k[1:] for k in pieces)


def scored(docs, **more):
    return {r.doc_id: r for r in L.score_texts(docs, rounds=1, **more).collect()}


def test_counts_and_base(documents):
    rows = [(i, f"The cat {i % 5} sat\x0bon  the\tMAT {'x' * (i % 3)}") for i in range(40)] + [(50, None), (51, ""), (52, "Ünseen wörds"), (53, "long " * 3000)]
    got = scored(documents(rows), common_words=3)  # most words take the joined way
    assert got == scored(documents(rows)) or all(
        got[i].n_known == r.n_known and got[i].score == pytest.approx(r.score) and got[i].base_score == pytest.approx(r.base_score)
        for i, r in scored(documents(rows)).items()
    )
    words = {i: L.words_of(None if t is None else t.encode()) for i, t in rows}
    learnt = [w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*ws, None]]
    n, v = len(learnt), len(set(learnt))
    for i, ws in words.items():
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and r.train_tokens == n and r.n_tokens == len(ws) + 1
        assert r.n_known == sum(w in learnt for w in [*ws, None])
        assert r.base_score == pytest.approx(sum(math.log10((learnt.count(w) + 1) / (n + v + 1)) for w in [*ws, None]))
        assert r.score < 0


def test_repeated_rows_and_no_id(documents):
    out = L.score_texts(documents([(1, "a b"), (1, "a b"), (None, "a b"), (3, "c")]), rounds=1).collect()
    assert len(out) == 4 and all(r.held_out for r in out if r.doc_id is None)
    assert len({round(r.score, 9) for r in out if r.doc_id != 3}) == 1


def test_empty_tables(documents):
    assert L.score_texts(documents([])).count() == 0
    held_only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = L.score_texts(documents([(held_only, "nothing learnt")])).first()
    assert r.train_tokens == 0 and r.base_score == 0.0 and r.n_known == 0 and r.score < 0


def test_likelier_in_order_of_frequency(spark, sf_dir):
    """Real texts beat the same texts with their letters shuffled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(2)
    mixed = [(10_000_000 + i, " ".join("".join(rng.sample(w, len(w))) for w in t.split())) for i, t in rows]
    mixed = [(i, t) for i, t in mixed if zlib.crc32(str(i).encode()) % 7 == 2]
    both = spark.createDataFrame(rows + mixed, "doc_id long, text string")
    got = {r.doc_id: r.score / r.n_tokens for r in L.score_texts(both, rounds=2).collect()}
    assert all(got[i] < got[i - 10_000_000] for i, _ in mixed)


def test_scores_come_from_four_rounds(spark, sf_dir):
    """Fewer rounds spell held-out words worse; the default is not cut short."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def held_out(**more):
        return sum(r.score for r in L.score_texts(docs, **more).where("held_out").collect())

    whole = held_out()
    assert whole == pytest.approx(held_out(rounds=4), rel=1e-9) and whole > held_out(rounds=2) + 1
