"""Routing, progress, file names and merges against literal loops."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folio_spark import schemas as S
from folio_spark.operators import attempts as A
from folio_spark.operators import downloads as W
from folio_spark.operators import merge as G
from folio_spark.operators import telemetry as T
from folio_spark.plans.metadata import retry_due, wanted_pages
from folio_spark.sources import tables as B


def literal_route(attempts):
    for n in sorted(attempts):
        kinds = attempts[n]
        if "ok" in kinds:
            return "success", n
        if "block" in kinds:
            return "deferred_block", n
    last = max(attempts)
    return ("deferred_short_html" if "short" in attempts[last] else "failed"), last


def test_route_matches_loop(spark):
    rng = random.Random(2)
    cases = {f"u{i}": {n: [rng.choice(["ok", "block", "short", "other", "other"]) for _ in range(rng.randint(1, 3))] for n in range(1, rng.randint(2, 5))} for i in range(400)}
    rows = [(u, n, k == "ok", k == "block", k == "short") for u, ats in cases.items() for n, ks in ats.items() for k in ks]
    df = spark.createDataFrame(rows, "detail_url string, attempt int, ok boolean, block boolean, short boolean")
    got = {r.detail_url: (r.outcome, r.decided_at) for r in A.route(df).collect()}
    assert got == {u: literal_route(a) for u, a in cases.items()}


def test_items_without_answer_are_dealt_over_tasks(spark):
    """Blank addresses and items without a usable page match nothing and do not meet in one task."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        url = F.when(F.col("id") % 2 == 0, "").otherwise(F.concat(F.lit("u"), "id"))
        items = spark.range(800).select(F.col("id").alias("seq"), url.alias("detail_url"))
        parsed = spark.range(0, 800, 8).select(F.concat(F.lit("u"), F.col("id") + 1).alias("url"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("any"))
        chosen = A.choose_response(items, parsed, "https://p.example")
        sizes = chosen.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(sizes) == 800 and max(sizes) < 300
        assert chosen.where("page IS NOT NULL").count() == 100 and chosen.where("stage = 'empty_url'").count() == 400
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def literal_names(files):
    taken, out = set(), {}
    for d, name, ord_ in sorted(files, key=lambda f: f[2]):
        stem, dot, ext = name.rpartition(".")
        if not stem:
            stem, dot, ext = name, "", ""
        final, n = name, 0
        while (d, final) in taken:
            n += 1
            final = f"{stem}({n}){dot}{ext}"
        taken.add((d, final))
        out[ord_] = final
    return out


def test_unique_names_match_loop(spark):
    rng = random.Random(9)
    pool = ["a.csv", "a.csv", "a.csv", "a(1).csv", "a(2).csv", "a(1)(1).csv", "a(3).csv", "b", "b(1)", "c.tar.gz", "c.tar(1).gz", "a(01).csv"]
    files = []
    for trial in range(60):
        files += [(f"d{trial}", rng.choice(pool)) for _ in range(rng.randint(1, 14))]
    rng.shuffle(files)
    rows = [(d, n, i) for i, (d, n) in enumerate(files)]
    df = spark.createDataFrame(rows, "dir string, name string, ord long").repartition(5)
    got = {r.ord: r.final_name for r in W.unique_names(df).collect()}
    assert got == literal_names(rows)


def test_unique_names_without_collisions(spark):
    df = spark.createDataFrame([("d", "a.csv", i) for i in range(3)], "dir string, name string, ord long")
    assert [r.final_name for r in W.unique_names(df).orderBy("ord").collect()] == ["a.csv", "a(1).csv", "a(2).csv"]


def test_running_percent_matches_fold(spark):
    rng = random.Random(4)
    rows = []
    for job in ("hot", "hot", "a", "b", "c"):
        for i in range(300 if job == "hot" else 40):
            kind = rng.choice(["set", "floor", "held", "held", "floor"]) if rng.random() < 0.6 else rng.choice(["floor", "held"])
            rows.append((job, len(rows), kind, {"set": rng.randint(0, 100), "floor": rng.choice([10, 30, 95, 96]), "held": rng.choice([8, 10])}[kind]))
    df = spark.createDataFrame(rows, "job_id string, line_no long, kind string, val long").repartition(5)
    got = {r.line_no: r.percent for r in T.running_percent(df, ["job_id"], ["line_no"]).collect()}
    last, want = {}, {}
    for job, n, kind, val in rows:
        p = val if kind == "set" else max(last.get(job, 0), val)
        last[job] = min(p, 30) if kind == "held" else p
        want[n] = last[job]
    assert got == want


def test_progress_line(spark):
    log = spark.createDataFrame([("j", 1, "[⭐️DETAIL]    50/913   (  5.5%) | 성공 50 | 실패 0")], "job_id string, line_no long, line string")
    r = T.progress_events(log).first()
    assert (r.done, r.total, r.ok, r.fail, r.percent) == (50, 913, 50, 0, 33)


def test_block_cooldowns(spark):
    rows = [("j", datetime(2024, 1, 1, 0, 0, i), i) for i in range(9)]
    got = T.block_cooldowns(spark.createDataFrame(rows, "job_id string, ts timestamp, signal_id long")).orderBy("signal_id").collect()
    assert [got[i].cooldown for i in (0, 1, 2, 8)] == [4, 8, 12, 12] and got[0].cooldown_until == 0.0


def test_retry_wait(spark):
    now = datetime(2024, 1, 1, 12, 0, 0)
    for text, want in (("2024-01-01 11:59:00", 120.0), ("2024-01-01 11:55:00", 0.0), ("soon", 0.0)):
        log = spark.createDataFrame([(text, "https://p.example/data/1")], "collected_at string, url string")
        assert G.retry_wait(log, now).first().remain_seconds == want
        assert retry_due(log, now) == (want == 0)


def test_upsert_and_reconcile(spark):
    base = spark.createDataFrame([(1, "u1", "old", 0), (2, None, "n1", 1), (3, None, "n2", 2)], "seq long, detail_url string, dataset_name string, line_no long")
    newer = spark.createDataFrame([(1, "u1", "new", 0)], base.schema)
    got = [(r.seq, r.detail_url, r.dataset_name) for r in G.upserted(base, newer).collect()]
    assert got == [(1, "u1", "new"), (3, None, "n2")]
    old = spark.createDataFrame([(0, "u1", "a"), (1, "u2", "a"), (2, "u3", "a")], "line_no long, url string, stage string")
    ok = spark.createDataFrame([("u1",)], "detail_url string")
    again = spark.createDataFrame([(0, "u2", "b")], old.schema)
    assert {(r.url, r.stage) for r in G.reconcile_fails(old, ok, again).collect()} == {("u3", "a"), ("u2", "b")}


def test_project_and_align(spark):
    df = spark.createDataFrame([("n", "x")], "dataset_name string, extra string")
    assert B.project(df, ["views", "dataset_name"]).columns == ["dataset_name"]
    none = B.project(df, ["views"])
    assert none.columns == ["views"] and none.count() == 0
    assert B.align(df, S.METADATA).columns == [f.name for f in S.METADATA.fields]


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", "u2"), (1, "a", "u1")], "seq long, dataset_name string, detail_url string")
    B.save_metadata(rows, str(tmp_path / "m"), headers=False)
    assert B.previous_metadata(spark, str(tmp_path / "m")).orderBy("seq").first().dataset_name == "a"
    assert B.previous_metadata(spark, str(tmp_path / "missing")).count() == 0
    B.save_metadata(rows, str(tmp_path / "j"), fmt="json", headers=False)
    assert B.previous_metadata(spark, str(tmp_path / "j"), fmt="json").count() == 2
    B.save_chunks(rows, ["seq"], str(tmp_path / "c"), "x", cap=1)
    assert sorted(p.name for p in (tmp_path / "c").glob("chunk_no=*")) == ["chunk_no=0", "chunk_no=1"]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_fail_log_without_line_numbers(spark, tmp_path, fmt):
    """Lines count on from file to file by name, whatever size decides about reading first."""
    want = []
    for part, n in enumerate([3, 400, 1, 40]):
        names = [f"d{part}-{i}" for i in range(n)]
        rows = spark.createDataFrame([(d, "e" * 200) for d in names], "dataset_name string, error string").coalesce(1)
        rows.write.format(fmt).option("header", True).save(str(tmp_path / "log" / f"part={part}"))
        want += names
    got = B.fail_log(spark, str(tmp_path / "log"), fmt).orderBy("line_no").select("line_no", "dataset_name").collect()
    assert [(r.line_no, r.dataset_name) for r in got] == list(enumerate(want, 1))


def test_answers_are_never_broadcast(spark):
    """Items and answers grow together, and a file's size may be far below that of its rows."""
    items = spark.sql("select * from values (1, 'https://h/data/1/fileData.do'), (2, 'https://h/data/2/fileData.do'), (3, '') t(k, detail_url)")
    parsed = spark.sql("select * from values ('https://h/data/1/fileData.do', null, 7), ('https://p/data/2/fileData.do', 'HTTP status=503', 8) t(url, error, n)")
    for how, kept in (("left", {1: ("", 7), 2: ("fetch_detail_httpx", None), 3: ("empty_url", None)}), ("inner", {1: ("", 7), 2: ("fetch_detail_httpx", None)})):
        chosen = A.choose_response(items, parsed, "https://p", how)
        assert "Broadcast" not in chosen._jdf.queryExecution().executedPlan().toString()
        assert {r["k"]: (r["stage"], r["page"]["n"] if r["page"] else None) for r in chosen.collect()} == kept


def test_pages_nobody_asks_for_are_left_out(spark):
    """With many items too few pages pass by chance to matter, and every page that is asked for passes."""
    address = F.concat(F.lit("https://p/data/"), F.col("id").cast("string"), F.lit("/fileData.do"))
    items = spark.range(1_500_000).select(address.alias("detail_url"))
    pages = spark.range(1_400_000, 1_600_000).select("id", F.when(F.col("id") != 1_400_007, address).alias("url"))
    got = wanted_pages(items, pages, "https://p").agg(F.expr("count_if(id < 1500000)").alias("wanted"), F.expr("count_if(id >= 1500000)").alias("others")).first()
    assert wanted_pages(items, pages, "https://p").columns == pages.columns
    assert got["wanted"] == 99_999 and got["others"] < 5_000
