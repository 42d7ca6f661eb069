"""View and download counts of whole organisations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import listing as L


def org_counts_report(pages: DataFrame, portal_base: str, max_pages: int = 0) -> DataFrame:
    """All organisations at once: cards, first sightings, page walk, four columns.

    Pages are parsed once; ``max_pages`` caps an organisation's walk (0: no cap). A page answered
    with an HTTP error was never read, so it ends its organisation's walk like a missing one.
    """
    answered = pages.where(F.coalesce("status", F.lit(200)) < 400)
    cards = L.counts_cards(L.cap_pages(answered, max_pages), portal_base)
    first = L.keep_first(cards, ["org", "detail_url"], ["page_no", "pos"])
    return L.walk(first).select("org", "title", "views", "downloads", "detail_url")
