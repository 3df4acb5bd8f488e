"""Article, token, page and registry views derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.functions.text import clean_snippet, utc_text
from newsweave.operators.tokens import prepare_tokens
from newsweave.plans.refresh import (
    DEFAULT_FEED,
    SEARCH,
    arrival,
    as_articles,
    previous_articles,
    token_feed_articles,
)
from newsweave.session import configure
from newsweave.settings import Settings
from newsweave.schemas import TOKEN

AS_OF = 1706745600  # 2024-02-01 00:00:00 UTC
DAY = 86400

# name, symbol, threshold, mandatory, additional, feeds (tag, url)
TOKENS = [
    ("Onenst", "EAUXAN", 8.0, ["onenst", "stupid"], ["therea", "license", "ing"],
     [("asset-issuer", "feed0"), ("dao-governance", "feed1")]),
    ("Tionble", "TIONBLE", None, ["ndthe"], ["hean", "tion"], [("asset-issuer", "feed1")]),
    ("Queaux", "QX#", 6.5, ["lescion"], ["entre", "ción", ""], [("research", "feed2")]),
    ("Unseen Coin", "UNSEEN", None, [], ["defi", "the"], []),
]
# a token that keeps every article, as no score is below the bonus of 1
OPEN_TOKEN = ("Open Coin", "OPENALL", 0.5, [], ["ing"], [])


def as_of() -> Column:
    return F.lit(AS_OF).cast("bigint")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def raw_token_rows(spark: SparkSession, rows=TOKENS) -> DataFrame:
    """Tokens as a registry has them, named by their symbols."""
    configure(spark)
    data = [
        (name, symbol, {"chain": f"0x{symbol}"}, 2, threshold, mandatory, additional, feeds)
        for name, symbol, threshold, mandatory, additional, feeds in rows
    ]
    # the symbol alone identifies these, and reads well in results
    return spark.createDataFrame(data, TOKEN).withColumn("token_key", F.lower("symbol"))


def token_rows(spark: SparkSession, rows=TOKENS) -> DataFrame:
    return prepare_tokens(raw_token_rows(spark, rows), Settings())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the first line is the title."""
    doc = F.col("doc_id")
    base = F.lit(1704067200).cast("bigint") + (doc * 7919) % 2592000
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat(F.lit("/"), (doc % 40).cast("string")).alias("link"),
        F.col("text").alias("snippet"),
        "source",
        base.alias("timestamp"),
        F.col("text").alias("full_content"),
    )


def keyed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose keys collide: few titles, few links."""
    return (
        documents(spark, sf_dir)
        .withColumn("title", F.concat(F.lit("t"), (F.col("doc_id") % 7).cast("string")))
        .withColumn("snippet", F.col("full_content"))
    )


def _with_time(df: DataFrame, shift: Column) -> DataFrame:
    return df.withColumn("timestamp", F.col("timestamp") + shift).withColumn(
        "utc_time", utc_text("timestamp")
    )


def _token_of(index: Column) -> Column:
    keys = F.array(*(F.lit(t[1].lower()) for t in TOKENS))
    return F.get(keys, index.cast("int"))


def refresh_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Previous snapshot, search rows, shared feed and token feeds from documents."""
    doc = F.col("doc_id")
    articles = documents(spark, sf_dir).withColumn("snippet", clean_snippet("snippet"))
    tokens = token_rows(spark)
    zero = F.lit(0)

    previous = previous_articles(
        _with_time(articles.filter(doc % 5 == 0), F.lit(-15 * DAY)).withColumns(
            {
                "token_key": _token_of(doc % 3),
                "tag": F.lit("independent-news"),
                "pinned": doc % 4 == 0,
                "position": doc,
            }
        )
    )
    search = as_articles(
        _with_time(articles.filter(doc % 5 < 2), zero).withColumns(
            {
                "token_key": _token_of(doc % 4),
                "tag": F.lit("independent-news"),
                "arrival": arrival(SEARCH, zero, zero, doc),
            }
        ),
        "token_key",
    )
    default_feed = as_articles(
        _with_time(
            articles.filter(doc % 5 != 4), (doc % 2) * 50 - 20
        ).withColumns(
            {
                "tag": F.lit("independent-news"),
                "arrival": arrival(DEFAULT_FEED, zero, zero, doc),
            }
        )
    )
    token_feed = token_feed_articles(
        _with_time(articles.filter(doc % 5 == 4), zero).withColumns(
            {
                "url": F.concat(F.lit("feed"), (doc % 3).cast("string")),
                "page": zero,
                "item": doc,
            }
        ),
        tokens,
    )
    return {
        "tokens": tokens,
        "previous": previous,
        "search": search,
        "default_feed": default_feed,
        "token_feed": token_feed,
    }
