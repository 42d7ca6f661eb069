"""Line dedup against all pairs."""

import random

import pytest

from folio_spark.llm import line_dedup as L

from .conftest import rows_of


def brute_force(rows, shingle=L.SHINGLE, threshold=L.THRESHOLD):
    """doc_id -> text, comparing every line with every other."""
    order = sorted((i is None, i or 0, n, line, k) for k, (i, t) in enumerate(rows) for n, line in enumerate(L.normal_lines(t)) if line)
    lines = list(dict.fromkeys(x[3] for x in order))
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, a in enumerate(lines):
        for b in lines[:p]:
            if min(len(a), len(b)) >= shingle and L.jaccard(a, b, shingle) >= threshold:
                root[find(a)] = find(b)
    first = {}
    for none, i, n, line, _ in order:
        first.setdefault(find(line), (none, i, n))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None))
        else:
            lines = zip(t.split("\n"), L.normal_lines(t))
            out.append((i, "\n".join(x for n, (x, plain) in enumerate(lines) if not plain or first[find(plain)] == (i is None, i or 0, n))))
    return sorted(out, key=repr)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta"]) + str(rng.randrange(30)) for _ in range(n))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(99))
    return " ".join(words)


@pytest.mark.parametrize("bucket", [L.BUCKET, 3])
def test_like_all_pairs(spark, documents, bucket):
    rng = random.Random(5)
    base = [prose(rng, 30) for _ in range(8)]
    rows = [(i, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 4])) for _ in range(4))) for i in range(60)]
    rows += [(100 + i, edited(rng, base[0], 1)) for i in range(40)]  # one large group of near copies
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "Ab"), (204, "ab\nAB \nb"), (205, "  Mixed   CASE line here \nmixed case line here")]
    rows += [(None, base[1]), (None, "only here, under no id"), (300, "word " * 5000)]
    got = rows_of(L.dedup_lines(documents(rows), bucket=bucket), "doc_id", "text")
    assert got == brute_force(rows)


def test_repeated_rows_are_one_document(documents):
    rows = [(1, "the very same line\nanother one"), (1, "the very same line\nanother one"), (2, "the very same line")]
    assert rows_of(L.dedup_lines(documents(rows)), "doc_id", "text") == [(1, "the very same line\nanother one")] * 2 + [(2, "")]


def test_keeps_columns_and_counts(documents):
    out = L.dedup_lines(documents([(1, "one line of text\nx"), (2, "one line of text\ny")]))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "line", "score", "_lines", "_kept"]
    assert rows_of(out, "doc_id", "_lines", "_kept") == [(1, 2, 2), (2, 2, 1)]


def test_empty_table(documents):
    assert L.dedup_lines(documents([])).count() == 0
    assert L.keep_with_lines(documents([])).count() == 0


def test_stage_drops_documents_without_text_left(documents):
    rows = [(1, "one line of text"), (2, "one line of text"), (3, "one line of text\nits own line"), (4, "")]
    out = L.keep_with_lines(documents(rows))
    assert rows_of(out, "doc_id", "text", "n_chars") == [(1, "one line of text", 16), (3, "its own line", 12), (4, "", 0)]
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "line", "score"]


def test_bucket_links_reach_every_similar_pair():
    rng = random.Random(9)
    base = prose(rng, 25)
    texts = list(dict.fromkeys([edited(rng, base, rng.randrange(6)) for _ in range(60)] + [prose(rng, 25) for _ in range(10)]))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in L.bucket_links(list(range(len(texts))), texts, L.SHINGLE, L.THRESHOLD):
        assert find(a) != find(b)
        root[find(a)] = find(b)
    for i in range(len(texts)):
        for j in range(i):
            if L.jaccard(texts[i], texts[j]) >= L.THRESHOLD:
                assert find(i) == find(j)


def test_banding_recall():
    """Pairs at Jaccard 0.8 to 0.85 share a band almost always."""
    rng, met, n = random.Random(3), 0, 0
    while n < 300:
        a = prose(rng, 40)
        b = edited(rng, a, 2)
        if 0.8 <= L.jaccard(a, b) <= 0.87:
            n += 1
            met += bool((L.band_keys([a], L.SHINGLE, L.BANDS, L.ROWS) == L.band_keys([b], L.SHINGLE, L.BANDS, L.ROWS)).any())
    assert met / n > 0.97


@pytest.mark.parametrize("letters", ["abcdefgh", "äöüßéèñç", "абвгдежз", "".join(map(chr, range(0xAC00, 0xAE00)))])
def test_bucket_links_are_exact_in_every_alphabet(letters):
    rng = random.Random(4)
    base = "".join(rng.choice(letters) for _ in range(400))
    texts = [base] + [base[:k] + "".join(rng.choice(letters) for _ in range(n)) + base[k + n :] for k, n in ((9, 20), (100, 33), (50, 44), (0, 60), (300, 36))]
    for other in texts[1:]:
        assert bool(L.bucket_links([0, 1], [base, other], L.SHINGLE, L.THRESHOLD)) == (L.jaccard(base, other) >= L.THRESHOLD)


def test_shingles_of_a_bucket_take_little_memory():
    """A full bucket of paragraphs, as executors hold several at once."""
    import tracemalloc

    rng = random.Random(6)
    texts = [prose(rng, 80) for _ in range(300)]
    tracemalloc.start()
    L.bucket_links(list(range(300)), texts, L.SHINGLE, L.THRESHOLD)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 * sum(map(len, texts))
