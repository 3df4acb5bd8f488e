"""Fixed schemas of every table read or written; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


STRING, LONG, DOUBLE, INT = StringType(), LongType(), DoubleType(), IntegerType()
BOOLEAN = BooleanType()

# Where a row came from, comparable field by field: source (0 previous snapshot,
# 1 search, 2 default feed, 3 token feed), list (query or feed), page, item.
ARRIVAL = _struct(source=INT, list=LONG, page=LONG, item=LONG)

ARTICLE = _struct(
    title=STRING,
    link=STRING,
    snippet=STRING,
    source=STRING,
    timestamp=LONG,
    utc_time=STRING,
    tag=STRING,
    relevance=DOUBLE,
    full_content=STRING,
    pinned=BOOLEAN,
    arrival=ARRIVAL,
)
ARTICLE_FIELDS = [f.name for f in ARTICLE]
ARTICLE_KEYS = ["source", "link", "title"]

# State table of one refresh: an article kept for a token, with its place in the
# token's list.
SNAPSHOT = _struct(
    token_key=STRING,
    **{f.name: f.dataType for f in ARTICLE if f.name != "arrival"},
    position=LONG,
)
PUBLISHED_FIELDS = [
    "title",
    "link",
    "snippet",
    "source",
    "timestamp",
    "utc_time",
    "tag",
    "full_content",
]

RSS_FEED = _struct(tag=STRING, url=STRING)
TOKEN = _struct(
    name=STRING,
    symbol=STRING,
    address=MapType(STRING, STRING),
    lookback_years=INT,
    relevance_threshold=DOUBLE,
    mandatory_phrases=ArrayType(STRING),
    additional_phrases=ArrayType(STRING),
    rss_feeds=ArrayType(RSS_FEED),
)

SEARCH_RESULT = _struct(
    title=STRING, link=STRING, snippet=STRING, source=STRING, date=STRING
)
SEARCH_RESPONSE = _struct(error=STRING, news_results=ArrayType(SEARCH_RESULT))

RSS_CHANNEL = _struct(
    title=STRING,
    item=ArrayType(
        _struct(title=STRING, link=STRING, description=STRING, pubDate=STRING)
    ),
)
ATOM_FEED = _struct(
    title=STRING,
    entry=ArrayType(
        _struct(
            title=STRING,
            link=ArrayType(_struct(_href=STRING, _rel=STRING)),
            summary=STRING,
            published=STRING,
            updated=STRING,
        )
    ),
)
# What a feed's root holds: channels of RSS, or the title and entries of an Atom feed; feeds
# may also be wrapped in a root of their own.
FEED_DOCUMENT = _struct(channel=ArrayType(RSS_CHANNEL), feed=ArrayType(ATOM_FEED), title=STRING, entry=ATOM_FEED["entry"].dataType)

NETWORKS = _struct(data=_struct(platformToChainIdMap=MapType(STRING, LONG)))
CANDIDATES = _struct(
    data=_struct(tokens=ArrayType(_struct(address=STRING, symbol=STRING)))
)
TOKEN_METADATA = _struct(chain_id=LONG, address=STRING, name=STRING, symbol=STRING)
CHAIN_NAMES = MapType(STRING, STRING)
CHAIN_RPCS = _struct(chainId=LONG, rpc=ArrayType(_struct(url=STRING)))
PAGE = _struct(page_id=LONG, url=STRING, html=STRING)
