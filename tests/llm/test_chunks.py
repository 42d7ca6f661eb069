"""Content-defined chunks against a byte-by-byte version."""

import hashlib
import random

import pytest

from folio_spark.llm import chunks as C

from .conftest import rows_of


def plain_chunks(raw):
    """Chunk the bytes one at a time."""
    out, start, h = [], 0, []
    for i in range(len(raw)):
        h.append(sum(int(C.GEAR[raw[j]]) << (i - j) for j in range(max(0, i - C.SMALLEST + 1), i + 1)) & 0xFFFFFFFF)
        size = i + 1 - start
        strict, loose = h[i] < 1 << (32 - C.STRICT_BITS), h[i] < 1 << (32 - C.LOOSE_BITS)
        if size == C.LARGEST or (size >= C.NORMAL and loose) or (size >= C.SMALLEST and strict):
            out.append(raw[start : i + 1])
            start = i + 1
    return out + ([raw[start:]] if start < len(raw) else [])


def texts(seed=1):
    rng = random.Random(seed)
    words = ["alpha", "béta", "γάμμα", "delta", "x"]
    return ["", "a", "short text", "z" * 5000] + [" ".join(rng.choices(words, k=rng.randrange(1, 400))) for _ in range(25)]


def test_chunks_like_plain():
    import xxhash

    some = [t.encode() for t in texts()]
    for raw, got in zip(some, C.chunk_sets(some)):
        parts = plain_chunks(raw)
        assert b"".join(parts) == raw
        assert got == {xxhash.xxh3_64_intdigest(p) >> 24: len(p) for p in parts}


def test_blocks_do_not_matter(monkeypatch):
    some = [t.encode() for t in texts()]
    whole = C.chunk_sets(some)
    monkeypatch.setattr(C, "BLOCK", 700)
    assert C.chunk_sets(some) == whole


def test_boundaries_realign_after_an_edit():
    rng = random.Random(3)
    text = " ".join(rng.choices(["one", "two", "three", "four"], k=3000)).encode()
    a, b = C.chunk_sets([text, b"put in front " + text[:4000] + b"middle" + text[4000:]])
    assert C.containment(a, b) > 0.97
    assert C.containment({}, {}) == 1.0 and C.containment({}, a) == 0.0 and C.containment(a, a) == 1.0


@pytest.mark.parametrize("buckets", [1, 2, 5, 40])
def test_next_document(documents, buckets):
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts(2))] + [(1000, None), (1001, "dup"), (1001, "dup"), (None, "no id"), (None, "also none")]
    got = rows_of(C.fingerprints_with_next(documents(rows), buckets), "doc_id", "n_chars", "edited_sha256", "fingerprint", "near_next")
    ordered = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    want = []
    for at, (known, i, t) in enumerate(ordered):
        following = ordered[(at + 1) % len(ordered)][2]
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        a, b = C.chunk_sets([t.encode(), following.encode()])
        want.append((i if known else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), C.written(a), C.containment(a, b)))
    assert got == sorted(want, key=repr)


def test_one_row_and_none(documents):
    r = C.fingerprints_with_next(documents([(5, "alone in the table")])).first()
    assert r.near_next == 1.0 and r.n_chars == 18
    assert C.fingerprints_with_next(documents([])).count() == 0


def test_shipped_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = C.fingerprints_with_next(docs).collect()
    assert len(got) == docs.count()
    by_text = {}
    for r in docs.join(spark.createDataFrame(got).select("doc_id", "fingerprint"), "doc_id").collect():
        assert by_text.setdefault(r.text, r.fingerprint) == r.fingerprint
    near = sorted(r.near_edited for r in got if r.n_chars > 500)
    assert near[len(near) // 20] > 0.6
