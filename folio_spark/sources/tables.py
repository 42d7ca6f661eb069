"""Page and run tables in, fixed-schema tables out (Parquet first, CSV and JSON too)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from .. import vocab as V
from ..functions.text import sheet_name
from ..operators.numbering import number_rows


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema).format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def listing_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, S.LISTING_PAGES, fmt)


def detail_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, S.DETAIL_PAGES, fmt)


def _loaded(spark: SparkSession, path: str, fields: list[tuple[str, str]], fmt: str) -> DataFrame:
    """The columns of a saved table under their internal names, with ``_metadata`` of the files."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=True, escape='"')
    found = reader.load(path)
    names = {header: name for name, header in fields}
    return found.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in found.columns], "_metadata")


def stored_table(spark: SparkSession, path: str, schema: T.StructType, fields: list[tuple[str, str]], fmt: str = "parquet") -> DataFrame:
    """A saved table, its columns found by name under the published or the internal header.

    Column order and further columns do not matter; a column the file lacks is null.
    """
    return align(_loaded(spark, path, fields, fmt), schema)


def fail_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A saved fail log (A3). One stored without line numbers is numbered by file name and place in the file."""
    rows = _loaded(spark, path, V.FAIL_FIELDS, fmt)
    if "line_no" not in rows.columns:
        # Numbers made while reading rise inside a block only: larger files are read first.
        rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_read"))
        rows = number_rows(rows.drop("_metadata"), ["_file", "_block", "_read"], "line_no")
    return align(rows, S.FAIL_LOG)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def previous_metadata(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The last run's metadata, or an empty table when there was none (A4)."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], S.METADATA)
    return stored_table(spark, path, S.METADATA, V.METADATA_FIELDS, fmt)


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Known columns in order, missing ones null, others dropped."""
    def column(f: T.StructField) -> Column:
        source = F.col(f.name) if f.name in df.columns else F.lit(None)
        return source.cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in schema.fields])


def project(df: DataFrame, chosen: list[str] | None = None) -> DataFrame:
    """The user's columns in the user's order; all selectable ones by default."""
    wanted = V.SELECTABLE if chosen is None else chosen
    present = [c for c in wanted if c in df.columns]
    if present:
        return df.select(*present)
    return df.sparkSession.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in wanted]))


def with_headers(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """Rename internal columns to the published headers."""
    return df.withColumnsRenamed({name: header for name, header in fields if name in df.columns})


def _write(df: DataFrame, path: str, fmt: str) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    (writer.options(header=True, escape='"') if fmt == "csv" else writer).save(path)


def sort_by_seq(df: DataFrame, *arrival: str) -> DataFrame:
    """Sort by sequence number; ties keep their arrival order."""
    return df.orderBy(F.col("seq").asc_nulls_last(), *arrival)


def save_metadata(df: DataFrame, path: str, fmt: str = "parquet", headers: bool = True, arrival: tuple[str, ...] = ("detail_url",)) -> None:
    ordered = align(sort_by_seq(df, *arrival), S.METADATA)
    _write(with_headers(ordered, V.METADATA_FIELDS) if headers else ordered, path, fmt)


def save_fails(df: DataFrame, path: str, fmt: str = "parquet", headers: bool = True) -> None:
    """Save a fail log; its line numbers, which order the next retry, are stored with it."""
    rows = align(df, S.FAIL_LOG if "line_no" in df.columns else S.FAILS)
    _write(with_headers(rows, V.FAIL_FIELDS) if headers else rows, path, fmt)


def save_counts(df: DataFrame, path: str, fmt: str = "parquet", headers: bool = True) -> None:
    rows = align(df, S.COUNTS)
    _write(with_headers(rows, V.COUNT_FIELDS) if headers else rows, path, fmt)


def chunks(df: DataFrame, order: list[str], base_name: str, cap: int = V.CHUNK_ROWS) -> DataFrame:
    """Number output chunks of at most ``cap`` rows and name them; a table that fits keeps its plain name."""
    size = max(1, min(cap, V.CHUNK_ROWS_MAX))
    numbered = number_rows(df, order, "_rn")
    chunk = F.floor((F.col("_rn") - 1) / size).cast("long")
    name = F.when(F.col("_split"), sheet_name(F.lit(base_name), (chunk + 1).cast("int"))).otherwise(sheet_name(F.lit(base_name)))
    split = numbered.agg((F.count("*") > size).alias("_split"))  # one row
    return numbered.join(F.broadcast(split)).select(*df.columns, chunk.alias("chunk_no"), name.alias("chunk_name"))


def save_chunks(df: DataFrame, order: list[str], path: str, base_name: str, cap: int = V.CHUNK_ROWS) -> None:
    chunks(df, order, base_name, cap).write.mode("overwrite").partitionBy("chunk_no").parquet(path)
