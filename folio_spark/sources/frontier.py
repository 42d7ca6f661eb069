"""List addresses to visit, and organisations read back from addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import UrlBuilder, list_url, org_from_url


def frontier(orgs: DataFrame, portal_base: str, per_page: int = 100, d_type: str = "FILE", url_builder: UrlBuilder | None = None) -> DataFrame:
    """One row per (org, page_no) with its list address (A5).

    ``url_builder(org, page, per_page)`` replaces the portal's address rule.
    """
    pages = F.greatest(F.lit(1), F.ceil(F.col("total_count") / per_page)).cast("int")
    listed = orgs.select("org", F.explode(F.sequence(F.lit(1), pages)).alias("page_no"))
    build = url_builder or (lambda o, p, n: list_url(o, p, n, portal_base, d_type))
    return listed.select("org", "page_no", build(F.col("org"), F.col("page_no"), F.lit(per_page)).alias("list_url"))


def orgs_from_urls(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(url, org) for addresses naming an organisation, and the rejected addresses."""
    read = urls.select("url", org_from_url(F.col("url")).alias("org"))
    named = read.where(F.col("org").isNotNull())
    rejected = read.where(F.col("org").isNull()).select("url", F.lit("no org/orgFilter/orgFullName parameter").alias("error"))
    return named, rejected
