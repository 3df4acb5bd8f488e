"""Article refresh for all tokens in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.articles import (
    keep_relevant,
    latest_articles,
    search_windows,
    within_window,
)
from ..operators.matching import match_tokens, score_assigned
from ..operators.tokens import own_feeds
from ..schemas import ARTICLE, ARTICLE_FIELDS, ARTICLE_KEYS

PREVIOUS, SEARCH, DEFAULT_FEED, TOKEN_FEED = range(4)
PINNED_RELEVANCE = 10.0


def arrival(source: int, *levels: Column) -> Column:
    """Place of a row: source, then list, page and item (0 where there is none)."""
    zero = F.lit(0).cast("bigint")
    levels = (*levels, *[zero] * (3 - len(levels)))
    names = ("list", "page", "item")
    return F.struct(
        F.lit(source).alias("source"),
        *(c.cast("bigint").alias(n) for n, c in zip(names, levels)),
    )


def as_articles(df: DataFrame, *extra: str) -> DataFrame:
    """Bring a table to the article schema; absent columns become typed nulls."""
    kinds = {f.name: f.dataType for f in ARTICLE}
    return df.select(
        *extra,
        *(
            F.col(n) if n in df.columns else F.lit(None).cast(kinds[n]).alias(n)
            for n in ARTICLE_FIELDS
        ),
    )


def previous_articles(snapshot: DataFrame) -> DataFrame:
    """Snapshot rows as arrivals; only a pinned score survives from the last run."""
    pinned = F.coalesce("pinned", F.lit(False))
    return as_articles(
        snapshot.withColumns(
            {
                "arrival": arrival(PREVIOUS, F.lit(0), F.lit(0), F.col("position")),
                "relevance": F.when(pinned, F.lit(PINNED_RELEVANCE)),
                "pinned": pinned,
            }
        ),
        "token_key",
    )


def token_feed_articles(feed_articles: DataFrame, tokens: DataFrame) -> DataFrame:
    """Articles of each token's own feeds, pinned, with the tag the token gave.

    ``feed_articles`` carries ``url`` (of the feed), ``page`` (fetch) and ``item``
    (place in it).
    """
    return as_articles(
        feed_articles.drop("tag")
        .join(own_feeds(tokens), "url")
        .withColumns(
            {
                "arrival": arrival(TOKEN_FEED, *map(F.col, ("feed", "page", "item"))),
                "relevance": F.lit(PINNED_RELEVANCE),
                "pinned": F.lit(True),
            }
        ),
        "token_key",
    )


def default_feed_articles(feed_articles: DataFrame, default_urls: DataFrame) -> DataFrame:
    """Articles of the feeds every token reads; ``default_urls`` is ``url, feed``."""
    return as_articles(
        feed_articles.join(default_urls, "url").withColumn(
            "arrival", arrival(DEFAULT_FEED, *map(F.col, ("feed", "page", "item")))
        )
    )


def refresh(
    tokens: DataFrame,
    previous: DataFrame,
    search: DataFrame,
    default_feed: DataFrame,
    token_feed: DataFrame,
    as_of: Column,
    *,
    strategy: str = "grams",
    windowed: bool = False,
) -> DataFrame:
    """The new state of every token: relevant articles, one per key.

    ``tokens`` comes from ``prepare_tokens``.  ``previous``, ``search`` and
    ``token_feed`` are articles with a ``token_key``, ``default_feed`` is articles
    all tokens share.  Shared articles are not copied per token: each is reduced to
    one row per key, and enters a token's list only where it scores, or where the
    token holds the same key and the newer of the two must win.  Search rows are
    cut to the window up to ``as_of``, unless ``windowed`` says that they are by now.
    """
    if not windowed:
        search = within_window(search, search_windows(tokens, previous, as_of)).select(search.columns)
    assigned = (
        previous.unionByName(search)
        .unionByName(token_feed)
        .withColumn("first_arrival", F.col("arrival"))
    )
    shared = latest_articles(default_feed)

    held = assigned.select(
        "token_key", *(F.col(k).alias(f"_{k}") for k in ARTICLE_KEYS)
    ).distinct()
    same_key = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in ARTICLE_KEYS]
    contenders = shared.join(held, same_key)
    matched = match_tokens(shared, tokens, strategy=strategy)

    columns = ["token_key", *ARTICLE_FIELDS, "first_arrival"]
    current = latest_articles(
        assigned.select(columns)
        .unionByName(contenders.select(columns))
        .unionByName(matched.select(columns)),
        ["token_key", *ARTICLE_KEYS],
    )
    scored = score_assigned(current, tokens)
    return keep_relevant(scored, "threshold").select(columns)
