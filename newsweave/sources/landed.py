"""Readers of landed search responses, feeds, registry and chain files.

Everything that a service would fetch over the network is read from files a fetcher
has landed.  All readers name their schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.dates import feed_epoch, parse_date
from ..functions.columns import join_spread, with_computed
from ..functions.text import SEARCH_TAG, clean_snippet, utc_text
from ..operators.articles import clean_articles
from ..operators.tokens import query_plan
from ..plans.refresh import SEARCH, arrival, as_articles
from ..schemas import (
    CANDIDATES,
    CHAIN_RPCS,
    FEED_DOCUMENT,
    NETWORKS,
    SEARCH_RESPONSE,
    TOKEN_METADATA,
)

UNKNOWN_FEED = "Unknown"


def _with(schema: StructType, **partitions) -> StructType:
    return StructType(
        schema.fields + [StructField(n, t) for n, t in partitions.items()]
    )


def _reader(spark: SparkSession, stream: bool, max_files: int | None):
    """A reader, or one of a stream that takes at most so many files a batch."""
    if not stream:
        return spark.read
    return spark.readStream.option("maxFilesPerTrigger", max_files) if max_files else spark.readStream


def _landing() -> Column:
    """The file a row came from, as the ledger of consumed landings knows it."""
    return F.col("_metadata.file_path").alias("landing")


# -- search --------------------------------------------------------------------------


def read_search(
    spark: SparkSession, path: str, *, lines: bool = True, stream: bool = False, files: list[str] | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Responses under ``<path>/query_id=<id>/page=<n>/fetched=<epoch>/``, one JSON text per line.

    A landing may leave out ``fetched``, the time of the response; it is null then.
    ``lines=False`` takes files that hold one pretty-printed response each, ``files`` reads
    these only.  ``landing`` is the file.
    """
    schema = _with(SEARCH_RESPONSE, query_id=StringType(), page=LongType(), fetched=LongType())
    if files is not None and not files:
        return spark.createDataFrame([], _with(schema, landing=StringType()))
    reader = _reader(spark, stream, max_files).schema(schema).option("multiLine", not lines)
    read = reader.json(path) if files is None else reader.option("basePath", path).json(files)
    return read.select("*", _landing())


def search_articles(responses: DataFrame, as_of: Column) -> DataFrame:
    """Article rows of all pages, with ``query_id``; an error response gives none.

    "3 hours ago" counts back from when the response was fetched, and from ``as_of`` only
    where that isn't known, so a page gives the same rows in every run.  Works on a
    stream as well.
    """
    results = (
        responses.filter("error is null")
        .select("query_id", "page", "fetched", "landing", F.posexplode("news_results").alias("item", "r"))
        .select("query_id", "page", "fetched", "landing", "item", "r.*")
    )
    dated = with_computed(results, "_date", parse_date("date", F.coalesce("fetched", as_of)))
    rows = clean_articles(dated).select(
        "query_id",
        "page",
        "fetched",
        "landing",
        "item",
        "title",
        "link",
        "snippet",
        "source",
        "_date.timestamp",
        "_date.date_source",
    )
    return rows.withColumns(
        {"utc_time": utc_text("timestamp"), "tag": F.lit(SEARCH_TAG)}
    )


def planned_queries(tokens: DataFrame) -> DataFrame:
    """The query plan with the id its responses are landed under."""
    return query_plan(tokens).withColumn("query_id", F.md5("query"))


def token_search_articles(
    articles: DataFrame, tokens: DataFrame
) -> DataFrame:
    """Search rows of each token's queries, ready for the refresh; ``fetched`` is kept for their window.

    Rows that don't say when they were fetched have a null there, as landings without it do.
    A token has 2^n queries, so the plan is never sent to the driver to be broadcast.
    """
    if "fetched" not in articles.columns:
        articles = articles.withColumn("fetched", F.lit(None).cast("bigint"))
    plan = planned_queries(tokens).select("query_id", "token_key", "query_order")
    return as_articles(
        join_spread(articles, plan, ["query_id"], articles.columns, merged=True).withColumn(
            "arrival",
            arrival(SEARCH, F.col("query_order"), F.col("page"), F.col("item")),
        ),
        "token_key",
        "fetched",
    )


# -- feeds ---------------------------------------------------------------------------


def _entries(feed: Column, kind: str) -> Column:
    """Title and entries of an RSS channel or an Atom feed, in one form."""

    def main_link(e: Column) -> Column:
        main = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        return F.coalesce(F.get(main, F.lit(0)), F.get(e["link"], F.lit(0)))["_href"]

    def form(title: Column, link: Column, summary: Column, published: Column, updated: Column) -> Column:
        return F.struct(
            title.alias("title"), link.alias("link"), summary.alias("summary"),
            published.alias("published"), updated.alias("updated"),
        )

    nothing = F.lit(None).cast("string")
    if kind == "rss":
        entries = F.transform(feed["item"], lambda e: form(e["title"], e["link"], e["description"], e["pubDate"], nothing))
    else:
        entries = F.transform(
            feed["entry"], lambda e: form(e["title"], main_link(e), e["summary"], e["published"], e["updated"])
        )
    return F.struct(F.coalesce(feed["title"], F.lit(UNKNOWN_FEED)).alias("feed_title"), entries.alias("entries"))


def read_feed_entries(
    spark: SparkSession, path: str, *, stream: bool = False, files: list[str] | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Entries of RSS and Atom documents, one document per feed and fetch.

    Layout: ``<path>/url=<escaped feed URL>/fetched=<epoch>/``.  ``files`` reads these only.
    Each document is read and parsed once; its root tells which kind it is.
    """
    schema = StructType([StructField("value", StringType()), StructField("url", StringType()), StructField("fetched", LongType())])
    if files is not None and not files:
        documents = spark.createDataFrame([], _with(schema, landing=StringType()))
    else:
        reader = _reader(spark, stream, max_files).schema(schema)
        read = reader.text(path, wholetext=True) if files is None else reader.option("basePath", path).text(files, wholetext=True)
        documents = read.select("*", _landing())
    parsed = with_computed(documents, "d", F.from_xml("value", FEED_DOCUMENT))
    entry = "struct<title:string,link:string,summary:string,published:string,updated:string>"
    none = F.array().cast(f"array<struct<feed_title:string,entries:array<{entry}>>>")
    feeds = F.concat(
        F.coalesce(F.transform("d.channel", lambda c: _entries(c, "rss")), none),
        F.coalesce(F.transform("d.feed", lambda f: _entries(f, "atom")), none),
        F.when(F.col("d.entry").isNotNull(), F.array(_entries(F.col("d"), "atom"))).otherwise(none),
    )
    keys = ["url", "fetched", "landing"]
    return (
        parsed.select(*keys, F.explode(feeds).alias("f"))
        .select(*keys, "f.feed_title", F.posexplode("f.entries").alias("item", "e"))
        .select(*keys, "feed_title", F.col("item").cast("bigint").alias("item"), "e.*")
    )


def feed_articles(entries: DataFrame, as_of: Column) -> DataFrame:
    """Article rows with the feed's ``url``, the fetch (``page``) and place ``item``.

    An entry without a date has the time of its fetch, ``as_of`` where that isn't known.
    """
    empty = F.lit("")
    fetched = F.coalesce("fetched", as_of)
    timed = with_computed(entries, "timestamp", feed_epoch("published", "updated", fetched))
    return timed.select(
        "url",
        F.col("fetched").alias("page"),
        "fetched",
        "landing",
        "item",
        F.coalesce("title", empty).alias("title"),
        F.coalesce("link", empty).alias("link"),
        clean_snippet("summary").alias("snippet"),
        F.col("feed_title").alias("source"),
        "timestamp",
        utc_text("timestamp").alias("utc_time"),
        F.lit(SEARCH_TAG).alias("tag"),
    )


# -- registry and chains -------------------------------------------------------------


def read_networks(spark: SparkSession, path: str) -> DataFrame:
    """``network, chain_id`` from the platform map."""
    raw = spark.read.schema(NETWORKS).option("multiLine", True).json(path)
    return raw.select(F.explode("data.platformToChainIdMap").alias("network", "chain_id"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """``network, address, symbol`` from files under ``<path>/network=<name>/``."""
    raw = (
        spark.read.schema(_with(CANDIDATES, network=StringType()))
        .option("multiLine", True)
        .json(path)
    )
    return raw.select("network", F.explode("data.tokens").alias("t")).select(
        "network", "t.address", "t.symbol"
    )


def read_token_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKEN_METADATA).json(path)


def read_chain_names(spark: SparkSession, path: str) -> DataFrame:
    """``pos, chain_id, chain_name`` from one JSON object of id to name."""
    text = spark.read.text(path, wholetext=True)
    names = F.from_json("value", "map<string,string>")
    return text.select(F.posexplode(names).alias("pos", "chain_id", "chain_name")).withColumn(
        "chain_id", F.col("chain_id").try_cast("bigint")
    )


def read_chain_rpcs(spark: SparkSession, path: str) -> DataFrame:
    """``pos, chainId, rpc`` from one JSON array of chains."""
    text = spark.read.text(path, wholetext=True)
    chains = F.from_json("value", f"array<{CHAIN_RPCS.simpleString()}>")
    return text.select(F.posexplode(chains).alias("pos", "c")).select("pos", "c.*")
