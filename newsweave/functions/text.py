"""Snippet cleaning and time rendering."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .columns import ColumnOrName, col

MAX_SNIPPET = 500
SEARCH_TAG = "independent-news"


def _unescape_udf():
    # a nested function travels to the workers by value, so they need no install
    def unescape(text: pd.Series) -> pd.Series:
        return text.map(html.unescape, na_action="ignore")

    return F.pandas_udf(unescape, StringType())


def unescape_html(c: ColumnOrName) -> Column:
    """Decode HTML entities, named and numeric.

    The 2,000-odd HTML5 names have no JVM-side counterpart, so this is the one
    place that crosses into Python.  Only texts that hold an ampersand travel:
    the others are sent as null and taken from the original column.
    """
    c = col(c)
    return F.coalesce(_unescape_udf()(F.when(F.contains(c, F.lit("&")), c)), c)


def strip_tags(c: ColumnOrName) -> Column:
    return F.regexp_replace(col(c), r"<[^>]+>", "")


def truncate(c: ColumnOrName, max_length: int = MAX_SNIPPET) -> Column:
    """Cut to ``max_length`` characters, at the last full stop if there is one."""
    c = col(c)
    head = F.substring(c, 1, max_length)
    from_end = F.instr(F.reverse(head), ".")
    sentence = F.substring(c, F.lit(1), F.lit(max_length + 1) - from_end)
    # a full stop that is the very first character does not count
    has_sentence = (from_end > 0) & (from_end < max_length)
    cut = F.when(has_sentence, F.concat(sentence, F.lit(" ..."))).otherwise(
        F.concat(head, F.lit("..."))
    )
    return F.when(F.length(c) <= max_length, c).otherwise(cut)


def clean_snippet(c: ColumnOrName, max_length: int = MAX_SNIPPET) -> Column:
    """Decode entities, strip tags, truncate; a missing snippet becomes ''."""
    decoded = unescape_html(F.coalesce(col(c), F.lit("")))
    return truncate(strip_tags(decoded), max_length)


def utc_text(epoch: ColumnOrName) -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm:ss UTC`` (the session zone is UTC)."""
    return F.date_format(F.timestamp_seconds(col(epoch)), "yyyy-MM-dd HH:mm:ss 'UTC'")
