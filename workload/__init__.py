"""Checked queries: Spark views over the given tables, and the same in SQL."""

from __future__ import annotations


def catalog() -> dict:
    """``name -> (run, sql)``; ``sql`` is None where SQL cannot express the query."""
    from . import articles, dated, documents, landed, registries

    return {**articles.QUERIES, **documents.QUERIES, **dated.QUERIES, **registries.QUERIES, **landed.QUERIES}
