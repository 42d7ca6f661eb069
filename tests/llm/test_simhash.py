"""SimHash links against all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from folio_spark.llm import simhash as S

from .conftest import rows_of


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def closure(marks, radius):
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    marks = list(marks)
    for i, a in enumerate(marks):
        for b in marks[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {m: find(m) for m in marks}


def test_fingerprint():
    for text in ["", None, "one", "Two  words", "A b\tc\nd e f", "Ünï cødé Ω words\x0bin a row", "x " * 70_000, " not white space"]:
        assert S.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_shingle_hash_is_sparks(spark):
    h = spark.sql("SELECT xxhash64('a b c d') AS h").first().h
    assert S.fingerprint(b"A b c d") == h % (1 << 64)


@pytest.mark.parametrize("parts", [2, 3, 4, 5])
def test_balls_cover_every_difference(parts):
    """Any way to spread 4 differences over the segments leaves one inside its ball."""
    cuts = S.segments(parts, 4)
    shift = [s for s, _, _ in cuts]
    near = {i: 0 for i in range(parts)} | {shift.index(s): r for s, _, r in cuts}
    probed = {i for i in range(len(cuts))}

    def spread(left, at):
        if at == parts - 1:
            yield [left]
            return
        for k in range(left + 1):
            for rest in spread(left - k, at + 1):
                yield [k, *rest]

    for way in spread(4, 0):
        assert any(i in probed and way[i] <= near[i] for i in range(parts))


@pytest.mark.parametrize("crowd,parts", [(64, 3), (2, 3), (64, 2)])
def test_links_close_like_all_pairs(spark, crowd, parts):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    marks = {b for b in base} | {0}
    for _ in range(250):
        m = rng.choice(base[:6])
        for _ in range(rng.randrange(0, 7)):
            m ^= 1 << rng.randrange(64)
        marks.add(m)
    table = spark.createDataFrame([(S._signed(m),) for m in marks], "mark long").repartition(3)
    found = S.links(table, crowd=crowd, parts=parts).collect()
    assert all((r.a ^ r.b) % (1 << 64) and ((r.a ^ r.b) % (1 << 64)).bit_count() <= 4 for r in found)
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        root[find(r.a % (1 << 64))] = find(r.b % (1 << 64))
    want = closure(marks, 4)
    for a in marks:
        for b in base + [0]:
            assert (find(a) == find(b)) == (want[a] == want[b])


def test_groups_and_stage(documents):
    text = " ".join(f"word{i}" for i in range(400))
    near = text + " tail"
    rows = [(5, text), (3, near), (9, text), (4, None), (7, ""), (8, " \n"), (2, "quite different words in this one"), (2, "quite different words in this one")]
    rows += [(None, text), (None, "no id and no group of its own")]
    got = {}
    for r in S.groups(documents(rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.component_id)
    assert got[5] == got[3] == got[9] == {3} and got[4] == got[7] == got[8] == {4} and got[2] == {2} and got[None] == {3, None}
    kept = S.keep_one(documents(rows))
    assert rows_of(kept, "doc_id") == sorted([(2,), (3,), (4,), (None,), (None,)], key=repr)
    assert "line" in kept.columns and kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_table(documents):
    assert S.op5_simhash(documents([])).count() == 0
    assert S.keep_one(documents([])).count() == 0


def test_component_is_smallest_reachable(spark, sf_dir):
    """The whole query on the smallest documents against all pairs of fingerprints."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = S.op5_simhash(docs).collect()
    marks = {r.doc_id: int(r.fingerprint, 16) for r in got}
    root = closure(set(marks.values()), 4)
    least = {}
    for doc_id, m in marks.items():
        least[root[m]] = min(least.get(root[m], doc_id), doc_id)
    assert all(r.component_id == least[root[marks[r.doc_id]]] for r in got)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").where(F.col("doc_id") % 7 == 0).collect()}
    assert all(plain_fingerprint(t) == marks[i] for i, t in texts.items())
