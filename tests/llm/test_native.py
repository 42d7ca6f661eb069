"""Preference formatting and Poisson mixing: literal loops, odd rows, and plans without Python."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from folio_spark.llm import poisson_mix as P
from folio_spark.llm import preference_chat as C

from .conftest import rows_of


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rendered(turns):
    out, spans = "", []
    for role, text in turns:
        out += f"<|im_start|>{role or ''}\n"
        start = len(out)
        out += f"{text or ''}<|im_end|>"
        if role == "assistant":
            spans.append((start, len(out)))
        out += "\n"
    return out, spans


def test_format_pairs(spark):
    rng = random.Random(6)
    pairs = []
    for k in range(60):
        said = [(rng.choice(["user", "assistant", "system", None]), rng.choice(["hi", "", None, "ünï\ncode", "x" * 300])) for _ in range(rng.randrange(0, 6))]
        cut = rng.randrange(0, len(said) + 1)
        other = said[:cut] + [("assistant", f"other {i}") for i in range(rng.randrange(0, 3))]
        pairs.append((k, said, other))
    held = [(k, [(i, *t) for i, t in enumerate(a)], [(i, *t) for i, t in enumerate(b)], "extra") for k, a, b in pairs] + [(99, None, None, "extra")]
    turn = "array<struct<turn:bigint,role:string,text:string>>"
    df = spark.createDataFrame(held, f"pair long, chosen {turn}, rejected {turn}, prompt_turns2 string").repartition(3)
    out = C.format_pairs(df)
    assert "Python" not in plan(out) and "Arrow" not in plan(out)
    got = {r.pair: r for r in out.collect()}
    for k, a, b in [*pairs, (99, [], [])]:
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        r = got[k]
        assert r.prompt_turns == n and r.prompt == rendered(a[:n])[0]
        for name, side in (("chosen", a), ("rejected", b)):
            text, spans = rendered(side[n:])
            assert r[name] == text and [tuple(s) for s in r[f"{name}_spans"]] == spans
            assert all(text[x:y].endswith("<|im_end|>") for x, y in spans)


def parted(said):
    """conv_id -> (chosen, rejected) as lists of (role, text), by a literal loop."""
    whole = {}
    for conv in {r[0] for r in said if r[0] is not None}:
        own = sorted({r[1:] for r in said if r[0] == conv}, key=lambda t: tuple((x is not None, x) for x in t))
        whole[conv] = [t[1:] for t in own]
    pairs = {}
    for conv, own in whole.items():
        at = int(hashlib.md5(str(conv).encode()).hexdigest()[:8], 16) % len(own)
        pairs[conv] = own, own[:at] + whole.get(conv + 1, [])[at:]
    return pairs


def test_conversations(spark):
    said = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "kept too"), (2, 0, "user", "q2"), (2, 1, "assistant", None), (3, 0, "user", "no answer")]
    said += [(2, 1, "assistant", None), (None, 0, "assistant", "nobody's"), (5, None, "system", "first"), (5, 7, "assistant", "same"), (6, 0, None, "same")]
    rng = random.Random(8)
    for conv in range(20, 90):
        said += [(conv, i, rng.choice(["user", "assistant", None]), rng.choice(["same", "", None, f"t{conv}", "y\n" * 9])) for i in range(rng.randrange(1, 9))]
    said += [(200, i, "assistant", "long " * 60_000) for i in range(4)] + [(201, i, "assistant", "long " * 60_000 + str(i // 3)) for i in range(4)]
    df = spark.createDataFrame([(*r, "extra") for r in said], "conv_id long, turn long, role string, text string, prompt string")
    out = C.op9_preference(df)
    assert "Python" not in plan(out) and "Arrow" not in plan(out)
    got = {r.conv_id: r for r in out.collect()}
    pairs = parted(said)
    assert set(got) == set(pairs) and len({r.prompt_turns for r in got.values()}) > 4
    for conv, (a, b) in pairs.items():
        n, r = 0, got[conv]
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert r.prompt_turns == n and r.prompt == rendered(a[:n])[0]
        for name, side in (("chosen", a), ("rejected", b)):
            text, spans = rendered(side[n:])
            assert r[name] == text and r[f"{name}_spans"] == ",".join(f"{x}-{y}" for x, y in spans)
    assert any("," in r.rejected_spans for r in got.values())
    assert C.op9_preference(df.limit(0)).count() == 0


def test_poisson_counts_by_inversion(spark):
    rates = [0.0, 0.05, 0.7, 3.0, 40.0, 900.0]
    steps = {r.rate: r.steps for r in spark.createDataFrame([(x,) for x in rates], "rate double").select("rate", P.cumulative(F.col("rate")).alias("steps")).collect()}
    for rate in rates[1:]:
        p = total = math.exp(-rate)
        log_p = -rate
        for k, c in enumerate(steps[rate]):
            assert c == pytest.approx(total, abs=1e-9)
            log_p += math.log(rate / (k + 1))
            p = math.exp(log_p)
            total += p
        assert steps[rate][-1] == pytest.approx(1, abs=1e-9)
    assert steps[0.0] == [1.0]


def test_replication(spark, documents):
    rows = [(i, f"text {i}") for i in range(3000)]
    docs = documents(rows)
    targets = spark.createDataFrame([("src0", 2.0), ("src1", 1.0), ("src1", 1.0), ("unknown", 9.0), ("src2", 0.0)], "source string, weight double")
    out = P.replicate(docs, targets, size=2.0)
    assert "Python" not in plan(out) and "Arrow" not in plan(out)
    got = out.groupBy("source").count().collect()
    counts = {r.source: r["count"] for r in got}
    assert set(counts) == {"src0", "src1"} and all(abs(n - 3000) < 4 * math.sqrt(3000) for n in counts.values())
    assert rows_of(out, "doc_id", "copy_no") == rows_of(P.replicate(docs.repartition(7), targets, size=2.0), "doc_id", "copy_no")
    times = {}
    for i, c in rows_of(out, "doc_id", "copy_no"):
        times.setdefault(i, []).append(c)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in times.values()) and len({len(v) for v in times.values()}) > 4
    assert out.columns == [*docs.columns, "copy_no", "shuffle_key"]


def test_odd_rows(documents):
    rows = [(1, "same"), (1, "same"), (None, "no id"), (None, None), (2, None), (3, "")] * 20
    docs = documents(rows).withColumn("source", F.when(F.col("doc_id") == 2, None).otherwise("one"))
    out = P.replicate(docs, size=4.0).collect()
    assert {r.source for r in out} <= {None, "one"} and len(out) > 100
    assert P.replicate(documents([])).count() == 0
    r = {x.source: x for x in P.rates(docs, power=1.0).collect()}
    assert r[None].rate == pytest.approx(1.0) and r["one"].n_docs == 100
