"""Decontamination against sliding every item over every text."""

import random

import pytest

from folio_spark.llm import cgk_decontam as K

from .conftest import rows_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def brute_force(text, items):
    words, found = K.words_of(text), set()
    for item_id, item in items:
        own = K.words_of(item)
        if len(own) >= K.MIN_WORDS:
            padded = words + [None] * K.allowed(len(own))
            if any(distance(padded[s : s + len(own)], own) <= K.allowed(len(own)) for s in range(max(0, len(padded) - len(own)) + 1)):
                found.add(item_id)
    return found


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(1, 5) for _ in range(rng.randrange(0, 9))]
        b = [rng.randrange(1, 5) for _ in range(rng.randrange(0, 9))]
        for most in (0, 1, 3, 9):
            assert K.edits(a, b, most) == min(distance(a, b), most + 1)
    assert K.edits([K.OTHER, 1], [K.OTHER, 1], 2) == 1


def cases(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 8, 13, 21, 34, 60])))) for i in range(30)]
    texts = []
    for k in range(120):
        words = rng.choices(vocabulary + ["the", "of"], k=rng.randrange(0, 120))
        if k % 2:
            item_id, item = rng.choice(items)
            own = item.split()
            for _ in range(rng.randrange(0, K.allowed(len(own)) + 2)):
                at = rng.randrange(len(own))
                rng.choice([lambda: own.__setitem__(at, "zz"), lambda: own.insert(at, "new"), lambda: len(own) > 1 and own.pop(at)])()
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() if k % 3 else w + "," for w in own]
        texts.append((k, " ".join(words)))
    return items, texts


def test_like_brute_force():
    items, texts = cases()
    found = K.leaks([t for _, t in texts], K.prepared(items))
    want = [brute_force(t, items) for _, t in texts]
    assert all(f <= w for f, w in zip(found, want))  # verified, so never too much
    missed = sum(len(w - f) for f, w in zip(found, want))
    assert missed <= 0.02 * sum(map(len, want)) and sum(map(len, want)) > 40


@pytest.mark.parametrize("n", [5, 12, 30, 70])
def test_recall_at_the_largest_distance(n):
    assert K.measured_recall(n, K.WALKS, K.KEYS_PER_WALK, K.PLACES) >= 0.97


def test_filter_loses_no_window():
    hits = [3, 4, 5, 9, 10, 30]
    import numpy as np

    for n, need in ((4, 2), (6, 3), (3, 1)):
        want = [s for s in range(40) if sum(s <= h <= s + n - 2 for h in hits) >= need]
        assert K._dense_windows(np.array(hits), n, need, 40).tolist() == want


def test_table(spark, documents):
    items, texts = cases(7)
    bench = [*items, (None, texts[0][1]), (900, None), (901, ""), (902, "too short"), items[0]]
    docs = documents([*texts, (500, None), (501, ""), (None, items[3][1]), (502, items[3][1]), (502, items[3][1])])
    benchmark = spark.createDataFrame([(i, t, 0.5) for i, t in bench], "item_id long, text string, score double")
    whole = rows_of(K.op6_decontaminate(docs, benchmark), "doc_id", "contaminated", "leaked_items")
    assert whole == rows_of(K.find_leaks(docs, benchmark, block=7).selectExpr("doc_id", "size(leaked_items) > 0", "leaked_items"), "*")  # items in turns
    by_id = {r[0]: r for r in whole}
    assert by_id[500][1:] == (False, []) and by_id[501][1:] == (False, []) and by_id[502][2] == [3] and by_id[None][2] == [3] and len(whole) == 125
    kept = K.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(not r[1] for r in whole)


def test_empty_tables(spark, documents):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert K.op6_decontaminate(documents([]), benchmark).count() == 0
    assert K.op6_decontaminate(documents([(1, "a text")]), benchmark).first().contaminated is False


def test_shipped_benchmark(spark, sf_dir):
    """Every exact copy of an item is found."""
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {r.doc_id: set(r.leaked_items) for r in K.op6_decontaminate(docs, bench).collect()}
    exact = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in r.text}
    assert exact and all(i in got[d] for d, i in exact)


def nearest_run(text, item):
    """Edit distance of the item to the run of the text's words nearest to it, by the plain table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for x in text:
        last, row = row, [0]
        for j, y in enumerate(item, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        best = min(best, row[-1])
    return best


def test_nearest_run():
    rng = random.Random(3)
    for _ in range(300):
        item = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 9))]
        text = [rng.randrange(0, 5) for _ in range(rng.randrange(0, 20))]
        assert K.nearest(item, text) == nearest_run([x or None for x in text], item)


def test_passages_cut_at_either_end_or_stretched(spark, documents):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.sample(vocabulary, n))) for i, n in enumerate([10, 15, 20, 30, 45, 60] * 10)]
    texts, short = [], []
    for i, item in items:
        own, k = item.split(), K.allowed(len(item.split()))
        after = rng.choices(vocabulary, k=40)
        stretched = list(own)
        for at in sorted(rng.sample(range(1, len(own)), k), reverse=True):
            stretched.insert(at, "new")
        forms = [own[k:], own[k:] + after, after + own[:-k], stretched + after, after + stretched + after, [w for j, w in enumerate(own) if not j or j % 6][-len(own) + k :]]
        texts += [(10 * i + f, " ".join(words)) for f, words in enumerate(forms)]
        short.append((10 * i + 9, " ".join(own[k + 1 :])))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: set(r.leaked_items) for r in K.op6_decontaminate(documents(texts + short), benchmark).collect()}
    within = [(d, i) for d, t in texts + short for i, item in items if nearest_run(t.split(), item.split()) <= K.allowed(len(item.split()))]
    assert {(d, i) for d, found in got.items() for i in found} <= set(within) and not any(got[d] for d, _ in short)
    lost = [d for d, i in within if i not in got[d]]
    assert len(within) >= 300 and len(lost) <= 0.02 * len(within), lost


def test_short_items_leak_as_whole_texts(spark, documents):
    items = [(1, "Four words are few"), (2, "four words, ARE few!"), (3, "one"), (4, ""), (5, "..."), (6, None), (7, "this item has five words")]
    texts = [(10, "four  words are\nfew"), (11, "four words are few more"), (12, "One."), (13, ""), (14, "..."), (15, None), (16, "this item has five words"), (17, "one one")]
    got = {}
    for some in (items, items[:6]):
        benchmark = spark.createDataFrame(some, "item_id long, text string")
        got[len(some)] = {r.doc_id: r.leaked_items for r in K.find_leaks(documents(texts), benchmark, block=2).collect()}
    want = {i: [] for i, _ in texts} | {10: [1, 2], 12: [3]}
    assert got[6] == want and got[7] == want | {16: [7]}
