"""Session settings and durable cut points shared by every job."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on; sizes are left to the cluster.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Cut points are files; drop them once nothing refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Call sites are recorded per column expression, which the page rules have thousands of.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "folio_spark", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**ENGINE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_DIRS: dict[str, str] = {}  # application id -> folder of a local session that asked for one


def use_local_folder(spark: SparkSession) -> None:
    """For tests and single-machine runs: a temporary folder where ``spark.checkpoint.dir`` is unset.

    A session with a cluster master is left alone, so ``shared_dir`` asks for the setting there.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and context.master.startswith("local") and "cluster" not in context.master:
        _LOCAL_DIRS.setdefault(context.applicationId, tempfile.mkdtemp(prefix="folio-"))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``."""
    path = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_DIRS.get(spark.sparkContext.applicationId)
    if not path:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage and continue from there.

    Used where two branches read the same expensive result (parsed pages, range
    partitions whose bounds must not be sampled twice). Losing an executor
    afterwards costs a re-read, never a re-parse.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
