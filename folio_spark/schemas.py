"""Spark schemas of the tables read and produced by the jobs."""

from __future__ import annotations

from pyspark.sql import types as T

from . import vocab as V


def _strings(fields, longs=("seq",)) -> T.StructType:
    return T.StructType(
        [T.StructField(n, T.LongType() if n in longs else T.StringType()) for n, _ in fields]
    )


METADATA = _strings(V.METADATA_FIELDS)
COLUMNS = _strings(V.COLUMN_FIELDS, longs=())
FAILS = _strings(V.FAIL_FIELDS, longs=())
COUNTS = _strings(V.COUNT_FIELDS, longs=("views", "downloads"))
FAIL_LOG = T.StructType([T.StructField("line_no", T.LongType())] + FAILS.fields)


def _typed(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


LISTING_PAGES = _typed(
    org=T.StringType(), page_no=T.IntegerType(), list_url=T.StringType(), status=T.IntegerType(), html=T.StringType()
)
DETAIL_PAGES = _typed(url=T.StringType(), status=T.IntegerType(), html=T.StringType(), fetched_at=T.TimestampType())
