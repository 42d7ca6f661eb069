"""Several tables committed together, batch by batch, without a service.

A batch writes each table into a folder of its own and then one small snapshot that names the
folders that count from now on. The snapshot is a single file, so it appears at once: a batch is
read whole or not at all, folders of a failed batch are named by nobody, and a batch that is
replayed after its commit is known by its stream and number and left out. One writer per place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = "version long, stream string, batch_id long, folder string"
KEPT_SNAPSHOTS = 10  # older ones are removed; a reader may lag this many commits


def _files(spark: SparkSession, pattern: str) -> tuple:
    """The file system of a path and what lies there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, [f.getPath() for f in system.globStatus(path) or []]


def _versions(spark: SparkSession, out: str) -> list[int]:
    return sorted(int(p.getParent().getName()[2:]) for p in _files(spark, f"{out}/snapshots/v=*/part-*")[1])


def _snapshot(spark: SparkSession, out: str, version: int) -> list:
    """Rows of a snapshot: live folders by version, and the last batch of every stream (no folder).

    As many as there were batches since the last :func:`compact`, and one for each stream.
    """
    return spark.read.schema(SNAPSHOT).parquet(f"{out}/snapshots/v={version}").orderBy("version").collect() if version else []


def last_version(spark: SparkSession, out: str) -> int:
    return max(_versions(spark, out), default=0)


def done(spark: SparkSession, out: str, stream: str, batch_id: int) -> bool:
    """Whether a batch of a stream is committed; a stream's batches come in order."""
    rows = _snapshot(spark, out, last_version(spark, out))
    return any(r.stream == stream and r.batch_id >= batch_id for r in rows if r.folder is None)


def stage(tables: dict[str, DataFrame], out: str, version: int) -> str:
    """Write tables where nobody reads them yet; returns the folder to commit."""
    folder = f"v{version}-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{out}/{name}/{folder}")
    return folder


def _commit(spark: SparkSession, out: str, version: int, live: list[tuple], streams: dict[str, int]) -> None:
    rows = live + [(version, s, b, None) for s, b in streams.items()]
    spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.mode("overwrite").parquet(f"{out}/snapshots/v={version}")
    system, _ = _files(spark, out)
    for old in _versions(spark, out)[:-KEPT_SNAPSHOTS]:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/snapshots/v={old}"), True)


def append(spark: SparkSession, out: str, tables: dict[str, DataFrame], stream: str, batch_id: int) -> None:
    """Add a batch to all tables at once; its rows get the ``version`` of the commit."""
    before = last_version(spark, out)
    version, rows = before + 1, _snapshot(spark, out, before)
    folder = stage({n: t.withColumn("version", F.lit(version).cast("long")) for n, t in tables.items()}, out, version)
    live = [tuple(r) for r in rows if r.folder is not None] + [(version, stream, batch_id, folder)]
    _commit(spark, out, version, live, {r.stream: r.batch_id for r in rows if r.folder is None} | {stream: batch_id})


def replace(spark: SparkSession, out: str, tables: dict[str, DataFrame]) -> None:
    """Put one folder in place of all live ones; rows keep the version they came with."""
    before = last_version(spark, out)
    folder = stage(tables, out, before + 1)
    streams = {r.stream: r.batch_id for r in _snapshot(spark, out, before) if r.folder is None}
    _commit(spark, out, before + 1, [(before + 1, None, None, folder)], streams)


def read(spark: SparkSession, out: str, name: str, schema) -> DataFrame:
    """All committed rows of a table."""
    folders = [r.folder for r in _snapshot(spark, out, last_version(spark, out)) if r.folder is not None]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{out}/{name}/{f}" for f in folders])


def vacuum(spark: SparkSession, out: str, names: tuple[str, ...]) -> int:
    """Remove folders that no kept snapshot names: replaced ones and those of failed batches.

    Run it between batches, as a batch's folders are not named before its commit.
    """
    named = {r.folder for v in _versions(spark, out) for r in _snapshot(spark, out, v)}
    gone = 0
    for name in names:
        system, found = _files(spark, f"{out}/{name}/v*")
        for path in found:
            if path.getName() not in named:
                gone += system.delete(path, True)
    return gone
