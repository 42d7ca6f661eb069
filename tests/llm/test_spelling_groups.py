import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio_spark.llm import spelling_groups as S

UPPER = str.maketrans(S.UPPER, S.LOWER)


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :])


def literal(docs):
    """The contract by loops over (doc_id, text)."""
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(UPPER)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    beside = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(beside[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def answers(docs):
    return sorted(tuple(r) for r in S.op12_spelling(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus(seed, stems, docs=60):
    rng = random.Random(seed)
    out = []
    for i in range(docs):
        words = []
        for _ in range(40):
            w = rng.choice(stems)
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k + 1 :], w[:k] + rng.choice("aßÿ") + w[k:]])
            words.append(rng.choice([w, w.capitalize(), w.upper()]))
        out.append((rng.choice([i, i // 2]), rng.choice([" ", ", ", "\n", "7"]).join(words)))
    return out


@pytest.mark.parametrize("seed,stems", [(1, ["spelling", "variants", "vocabulary", "gramme"]), (2, ["ababab", "bababa", "aaaaa", "aaaaaaa", "éàéàé"])])
def test_contract_by_loops(spark, documents, seed, stems):
    rows = corpus(seed, stems) + [(None, "Spelling speling spelling"), (5, None), (6, ""), (7, " 12 ×× ÷"), (8, "ÀÉÎÕÜ àéîõü Ààààà"), (8, "ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ")]
    docs = documents(rows)
    for clash in ("word", "key", "id", "n", "run", "doc"):
        docs = docs.withColumn(clash, F.lit("spelling"))
    assert answers(docs) == literal(rows)


def test_long_texts_and_runs(spark, documents):
    long = "ab" * 3_000
    rows = [(1, " ".join(["letters"] * 50_000)), (2, " ".join(["leters"] * 20)), (3, long), (4, f"{long} {long}x {long}x"), (5, f"{long}, {long}x")]
    got = answers(documents(rows))
    assert got == literal(rows)
    assert (long + "x", None, long + "x", 3, 1, None) in got


def test_empty_table(spark, documents):
    assert answers(documents([(1, "x")]).limit(0)) == []
    assert answers(documents([(1, None), (2, "one two")])) == []


WORDS = st.lists(st.text(alphabet="abcé", min_size=1, max_size=9), min_size=1, max_size=25, unique=True)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.integers(1, 30), st.sampled_from([(2, 3), (3, 4), (2, 5), (3, 3)]))
def test_lists_hold_every_near_word(words, share, lengths):
    """No pair is lost, whatever the dictionary; each edit leaves a gram."""
    short, long = lengths
    counts = Counter(s[p : p + q] for s in (S.marked(w, long) for w in words) for q in range(short, long + 1) for p in range(len(s) - q + 1))
    places = sum(n for g, n in counts.items() if len(g) == short)
    grams = [g for g in counts if len(g) > short and all(counts[g[:k]] * share > places for k in range(short, len(g)))]
    d = S.dictionary_of(grams, short, long)
    keyed = {w: S.keys(w, d) for w in words}
    for a in words:
        if len(a) > 1:
            assert S.bound(a, d) >= 1
        for b in words:
            if near(a, b) and min(len(a), len(b)) > 1:
                assert (keyed[a][1] & keyed[b][0]) and (keyed[b][1] & keyed[a][0])


def test_dictionary_counts_whole_vocabulary(spark):
    words = ["thing", "think", "thinks", "other", "others"]
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(3)
    d = S.dictionary(df, 3, 4, 12)
    counts = Counter(s[p : p + 3] for s in map(S.marked, words) for p in range(len(s) - 2))
    frequent = {g for g, n in counts.items() if n * 12 > sum(counts.values())}
    want = {s[p : p + 4] for s in map(S.marked, words) for p in range(len(s) - 3) if s[p : p + 3] in frequent}
    assert set(d.grams) == want and want


def test_roots_follow_long_chains(spark):
    n = 41
    forms = spark.createDataFrame([(i, i + 1 if i < n and i % 10 else None) for i in range(1, n + 1)], "id long, form long")
    want = {i: min(n, -(-i // 10) * 10) for i in range(1, n + 1)}
    assert {r["id"]: r["root"] for r in S.roots(forms).collect()} == want
