"""Token registry rows made ready for search, feeds and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.relevance import normalise_phrases
from ..settings import Settings


# 2^n queries are numbered with a long.
MAX_PHRASES = 62
BLOCK_BITS = 12


def token_key() -> Column:
    """Lower-case symbol and a digest of the token's addresses.

    Two tokens with one symbol stay apart.
    """
    pairs = F.transform(
        F.map_entries("address"),
        lambda e: F.concat_ws(":", e["key"], F.lower(e["value"])),
    )
    digest = F.md5(F.coalesce(F.array_join(F.array_sort(pairs), ","), F.lit("")))
    return F.concat_ws("-", F.lower("symbol"), digest)


def phrase_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def keyword_list() -> Column:
    """Name, symbol and mandatory phrases, in that order."""
    return F.concat(F.array("name", "symbol"), phrase_or_empty("mandatory_phrases"))


def effective_threshold(settings: Settings) -> Column:
    return F.coalesce(
        "relevance_threshold", F.lit(settings.default_relevance_threshold)
    )


def prepare_tokens(tokens: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Registry plus ``token_key, keywords, phrases, threshold``, defaults filled in.

    A ``token_key`` that is already there is kept.
    """
    if "token_key" not in tokens.columns:
        tokens = tokens.withColumn("token_key", token_key())
    return tokens.withColumns(
        {
            "keywords": normalise_phrases(keyword_list()),
            "phrases": normalise_phrases("additional_phrases"),
            "threshold": effective_threshold(settings),
            "lookback_years": F.coalesce(
                "lookback_years", F.lit(settings.default_lookback_years)
            ),
        }
    )


def own_feeds(tokens: DataFrame) -> DataFrame:
    """``token_key, feed, tag, url``: the feeds each token lists."""
    return tokens.select(
        "token_key", F.posexplode("rss_feeds").alias("feed", "f")
    ).select("token_key", F.col("feed").cast("bigint").alias("feed"), "f.tag", "f.url")


def query_plan(tokens: DataFrame) -> DataFrame:
    """``token_key, query_order, n_phrases, query`` for every phrase combination.

    2^n rows for n additional phrases, one per bit mask, the first phrase on the
    highest bit.  ``query_order`` sorts shortest first, then by position of the
    phrases; it follows from the mask, so no token's queries need to meet in one
    task.  A token with more than 62 phrases has more queries than can be numbered, and
    stops the job.
    """
    extra = phrase_or_empty("additional_phrases")
    base = F.concat_ws(
        " ",
        F.col("name"),
        F.col("symbol"),
        F.array_join(phrase_or_empty("mandatory_phrases"), " "),
    )
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    left, right = (
        lambda c, n, op=op: F.call_function(op, c, n) for op in ("shiftleft", "shiftright")
    )

    def chosen(i: Column) -> Column:
        return right(F.col("mask"), F.col("n") - 1 - i).bitwiseAND(one) == 1

    last = F.col("total") - 1
    combination = F.array_join(F.filter("extra", lambda p, i: chosen(i)), " ")
    n_phrases = F.bit_count("mask").cast("bigint")
    refuse = F.raise_error(
        F.concat(F.lit("too many additional phrases for a query plan: "), F.col("token_key"))
    ).cast("bigint")
    masks = (
        tokens.select(
            "token_key", base.alias("base"), extra.alias("extra"), F.size(extra).alias("n")
        )
        .withColumn("total", F.when(F.col("n") <= MAX_PHRASES, left(one, F.col("n"))).otherwise(refuse))
        .withColumn("mask", zero)
    )
    # masks are opened a few bits at a time, so no array holds more than 4096 of them
    for bits in range(MAX_PHRASES - MAX_PHRASES % BLOCK_BITS, -1, -BLOCK_BITS):
        low = left(F.col("mask"), F.lit(BLOCK_BITS))
        high = F.least(low + (2**BLOCK_BITS - 1), right(last, F.lit(bits)))
        masks = masks.withColumn("mask", F.explode(F.sequence(low, high)))
    return (
        masks.select(
            "token_key",
            (n_phrases * F.col("total") + last - F.col("mask")).alias("query_order"),
            n_phrases.alias("n_phrases"),
            F.when(F.col("mask") == 0, F.col("base"))
            .otherwise(F.concat_ws(" ", "base", combination))
            .alias("query"),
        )
    )
