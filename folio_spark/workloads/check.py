"""Compare registered queries with their SQL on one data folder.

``python -m folio_spark.workloads.check <sf_dir> [name ...]``
"""

from __future__ import annotations

import sys
import time

import pandas as pd
from pyspark.sql import SparkSession

from ..session import use_local_folder

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float):
            return round(v, 6)
        return v.item() if hasattr(v, "item") else v

    ordered = df[sorted(df.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in ordered.itertuples(index=False)), key=repr)


def mismatch(spark: SparkSession, con, fn, sql: str | None, sf_dir: str) -> tuple[str | None, int]:
    got = fn(spark, sf_dir).toPandas()
    if sql is None:
        return None, len(got)
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}", len(got)
    a, b = _rows(got), _rows(want)
    if len(a) != len(b):
        extra, short = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
        return f"rows {len(a)} != {len(b)}; only ours {extra}; only SQL {short}", len(got)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        names = sorted(got.columns)
        first = {n: (x, y) for n, x, y in zip(names, *bad[0]) if x != y}
        return f"{len(bad)} rows differ, first (ours, SQL) {first}", len(got)
    kinds = [[isinstance(v, str) for v in rows[0]] for rows in (a, b) if rows]
    return ("text against number" if kinds and kinds[0] != kinds[1] else None), len(got)


def main() -> None:
    from . import ORACLES, QUERIES

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    use_local_folder(spark)
    con = oracle_connection(sf_dir)
    failed = 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            problem, n = mismatch(spark, con, QUERIES[name], ORACLES.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={n} {time.time() - start:.1f}s {problem or ''}"[:1800], flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
