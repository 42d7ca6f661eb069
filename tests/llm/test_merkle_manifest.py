import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from folio_spark.llm import merkle_manifest as M


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(digests, arity):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def path(tree, i, arity):
    out = []
    for held in tree[:-1]:
        first = i - i % arity
        out.append((held[first:i], held[i + 1 : first + arity]))
        i //= arity
    return out


def literal(rows, arity=2):
    """The contract by loops: rows are (doc_id, source, lang, n_chars, text)."""
    def leaf(r, more=0):
        n = None if r[3] is None else r[3] + more
        return sha(*map(field, (r[0], r[1], r[2], n, r[4])))

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    held = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: levels([leaf(r) for r in held[x]], arity) for x in langs}
    top = levels([trees[x][-1][0] for x in langs], arity)
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(held[x]):
            proof = path(trees[x], i, arity) + path(top, k, arity)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            d = leaf(r, 1 if tampered else 0)
            for before, after in proof:
                d = sha(*before, d, *after)
            siblings = sha(*[s for before, after in proof for s in (*before, *after)])
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], siblings, d, d == top[-1][0]))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def made(spark, rows):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    docs = spark.createDataFrame(rows, schema).repartition(4)
    return docs.withColumn("rank", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("tree", F.lit(None).cast("int"))


def rows_of(n, langs=("en", None, "de", "Zu", "é"), hot=3):
    out = []
    for i in range(n):
        lang = "en" if i % hot == 0 else langs[i % len(langs)]
        out.append((i * 3, f"src{i % 4}" if i % 5 else None, lang, i if i % 6 else None, "" if i % 9 == 0 else (None if i % 11 == 0 else "té\n" * (i % 13))))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 17, 130])
def test_contract_by_loops(spark, n):
    rows = rows_of(n)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in M.op11_manifest(made(spark, rows)).collect()), key=repr)
    assert got == literal(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (7, "a", "en", 1, "x"), (7, "a", "en", 1, "x"), (7, "b", "en", 2, "y" * 300_000), (21, "a", "en", None, "x")]
    rows += [(i, None, "en", i, str(i)) for i in range(40)]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in M.op11_manifest(made(spark, rows)).collect()), key=repr)
    assert got == literal(rows)
    assert len(got) == len(rows)


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_one_language(spark, n):
    rows = [(i, None, "en", i, f"text {i}") for i in range(n)]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in M.op11_manifest(made(spark, rows)).collect()), key=repr) == literal(rows)


def test_empty_table(spark):
    got = M.op11_manifest(made(spark, rows_of(1)).limit(0))
    assert got.count() == 0 and got.columns == list(COLUMNS)


@pytest.mark.parametrize("arity,digits", [(2, 1), (2, 3), (3, 2), (4, 1)])
def test_any_arity_and_block(spark, arity, digits):
    rows = rows_of(75, langs=("en", "de", "fr", None))
    m = M.manifest(made(spark, rows), "lang", "doc_id", row=F.col("doc_id"), arity=arity, digits=digits)
    want = {r[0]: r for r in literal(rows, arity)}
    found = M.proofs(m).select("row", "digest", "subroot", "proof", M.fold(F.col("digest"), F.col("proof")).alias("folded")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["digest"], r["subroot"], r["folded"]) == (want[r["row"]][1], want[r["row"]][2], m.root)
        assert sha(*[s["before"] + s["after"] for s in r["proof"]]) == want[r["row"]][4]


def test_some_requests(spark):
    rows = rows_of(60)
    m = M.manifest(made(spark, rows), "lang", "doc_id", row=F.col("doc_id"), digits=2)
    asked = m.leaves.where("row % 7 = 0").select("tree", "rank", "row")
    found = M.proofs(m, asked).select("row", M.fold(F.col("digest"), F.col("proof")).alias("folded")).collect()
    assert sorted(r["row"] for r in found) == [r[0] for r in rows if r[0] % 7 == 0]
    assert {r["folded"] for r in found} == {m.root}


def test_records_are_addressed_by_content(spark):
    """Equal subtrees are stored once, and a record's levels lead up to its address."""
    rows = [(1, "a", lang, 2, "same") for lang in ("en",) for _ in range(8)]
    m = M.manifest(made(spark, rows), "lang", "doc_id", digits=1)
    records = m.store.collect()
    assert len({(r["digest"], r["depth"]) for r in records}) == len(records)
    assert len(records) == 4  # one per level of eight equal leaves, and the root's own
    assert {r["folded"] for r in M.proofs(m).select(M.fold(F.col("digest"), F.col("proof")).alias("folded")).collect()} == {m.root}
    for r in records:
        assert r["levels"][-1] == [r["digest"]]
        for low, high in zip(r["levels"], r["levels"][1:]):
            assert high == levels(low, 2)[1]
