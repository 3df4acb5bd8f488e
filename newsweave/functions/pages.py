"""Publication date of an HTML page: meta tags, then JSON-LD, then visible text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnOrName, bind, blank_to_null, col
from .dates import absolute_epoch, relative_epoch
from .wordlists import META_DATE_TAGS, MONTHS

META = r"(?is)<meta\b[^>]*>"
CONTENT = r"""(?is)\scontent\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
JSON_LD = (
    r"""(?is)<script\b[^>]*\stype\s*=\s*["']?application/ld\+json["']?[^>]*>"""
    r"(.*?)</script\s*>"
)
UNSEEN = (
    r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
    r"|<template\b.*?</template\s*>"
)
COMMENT = r"(?s)<!--.*?-->"
TAG = r"(?s)<[^>]*>"

_SHORT = "|".join(m[:3] for m in MONTHS)
_LONG = "|".join(MONTHS)
ISO = r"\d{4}-\d{2}-\d{2}"
SLASHED = r"\d{2}/\d{2}/\d{4}"
SHORT_MONTH_DAY = rf"\b(?:{_SHORT})\s+\d{{1,2}},?\s+\d{{4}}"
DAY_LONG_MONTH = rf"\d{{1,2}}\s+(?:{_LONG})\s+\d{{4}}"
TIME_AGO = r"\b\d+\s+(?:second|minute|hour|day|week|month|year)s?\s+ago\b"
LONG_MONTH_DAY = rf"\b(?:{_LONG})\s+\d{{1,2}},?\s+\d{{4}}"


def meta_tag(attribute: str, value: str) -> str:
    """Pattern of a meta tag that carries ``attribute="value"``."""
    value = value.replace(".", r"\.")
    return (
        rf"""(?is)\s{attribute}\s*=\s*(?-i:"{value}"|'{value}'|{value}[\s/>])"""
    )


def _first_group(c: Column, pattern: str, groups: int) -> Column:
    return F.concat(*(F.regexp_extract(c, pattern, i) for i in range(1, groups + 1)))


def _first_date(candidates: Column, ignore_offset: bool = False) -> Column:
    """Epoch of the first candidate text that is a date and nothing else."""
    epochs = F.transform(
        candidates,
        lambda c: absolute_epoch(c, ignore_offset=ignore_offset, strict=True),
    )
    return F.get(F.filter(epochs, F.isnotnull), F.lit(0))


def _meta_texts(page: Column) -> Column:
    """Content of the first meta tag of each kind, in order of trust."""

    def content(tags: Column, pattern: str) -> Column:
        tag = F.get(F.filter(tags, lambda t: t.rlike(pattern)), F.lit(0))
        return _first_group(tag, CONTENT, 3)

    return bind(
        F.regexp_extract_all(page, F.lit(META), F.lit(0)),
        lambda tags: F.array(*(content(tags, meta_tag(a, v)) for a, v in META_DATE_TAGS)),
    )


def _json_ld_texts(page: Column) -> Column:
    """``datePublished``, else ``uploadDate``, of every script that is an object."""
    return F.transform(
        F.regexp_extract_all(page, F.lit(JSON_LD), F.lit(1)),
        lambda body: F.coalesce(
            blank_to_null(F.get_json_object(body, "$.datePublished")),
            blank_to_null(F.get_json_object(body, "$.uploadDate")),
        ),
    )


def meta_epoch(html: ColumnOrName, *, ignore_offset: bool = False) -> Column:
    """From the first tag of each kind; unreadable ones are passed over."""
    return _first_date(_meta_texts(col(html)), ignore_offset)


def json_ld_epoch(html: ColumnOrName, *, ignore_offset: bool = False) -> Column:
    """From the first script whose date can be read."""
    return _first_date(_json_ld_texts(col(html)), ignore_offset)


def visible_text(html: ColumnOrName) -> Column:
    """Text of a page without tags, scripts, styles and comments."""
    text = F.regexp_replace(F.regexp_replace(col(html), UNSEEN, ""), TAG, "")
    return F.translate(F.replace(text, F.lit("&nbsp;"), F.lit(" ")), " ", " ")


def text_epoch(html: ColumnOrName, as_of: Column) -> Column:
    """First readable date in the visible text, form by form."""

    def read(text: Column) -> Column:
        def found(*patterns: str) -> Column:
            return F.array(*(F.regexp_extract(text, p, 0) for p in patterns))

        return F.coalesce(
            _first_date(found(ISO, SLASHED, SHORT_MONTH_DAY, DAY_LONG_MONTH)),
            relative_epoch(F.regexp_extract(text, TIME_AGO, 0), as_of),
            _first_date(found(LONG_MONTH_DAY)),
        )

    return bind(visible_text(html), read)


def publication_date(
    html: ColumnOrName, as_of: Column, *, ignore_offset: bool = False
) -> Column:
    """``struct<date_source, epoch>`` of a page; both null when there is no date.

    The three readers run in turn: a page with a usable meta tag never pays for the
    text scan.
    """
    page = F.regexp_replace(col(html), COMMENT, "")

    def tagged(epoch: Column, source: str) -> Column:
        labelled = F.struct(F.lit(source).alias("date_source"), epoch.alias("epoch"))
        return F.when(epoch.isNotNull(), labelled)

    return bind(
        page,
        lambda p: F.coalesce(
            bind(meta_epoch(p, ignore_offset=ignore_offset), lambda e: tagged(e, "meta")),
            bind(
                json_ld_epoch(p, ignore_offset=ignore_offset),
                lambda e: tagged(e, "json-ld"),
            ),
            bind(text_epoch(p, as_of), lambda e: tagged(e, "text")),
        ),
    )
