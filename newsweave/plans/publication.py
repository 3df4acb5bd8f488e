"""Publication dates for a table of web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions.columns import with_computed
from ..functions.pages import publication_date


def publication_dates(
    pages: DataFrame, as_of: Column, *, ignore_offset: bool = False
) -> DataFrame:
    """``page_id, url, epoch, date_source``; a map-only job over the pages."""
    found = publication_date("html", as_of, ignore_offset=ignore_offset)
    return with_computed(pages, "_found", found).select(
        "page_id", "url", "_found.epoch", "_found.date_source"
    )
