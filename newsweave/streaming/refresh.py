"""The refresh as a stream: landed search responses and feeds in, scored snapshots out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tokens import prepare_tokens
from ..plans.runs import commit_refresh
from ..settings import Settings
from ..sources.landed import feed_articles, read_feed_entries, read_search, search_articles


def landed_articles(
    spark: SparkSession, search_path: str, feeds_path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Search rows and feed rows as they land, one stream; feed rows have no ``query_id``."""
    never = F.lit(0).cast("bigint")
    search = search_articles(read_search(spark, search_path, stream=True, max_files=max_files_per_trigger), never)
    feeds = feed_articles(read_feed_entries(spark, feeds_path, stream=True, max_files=max_files_per_trigger), never)
    return search.unionByName(feeds, allowMissingColumns=True)


def refresh_stream(
    spark: SparkSession,
    settings: Settings,
    tokens: DataFrame,
    *,
    search_path: str,
    feeds_path: str,
    snapshots: str,
    published: str,
    checkpoint: str,
    as_of: int = 0,
    interval: str | None = None,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Refresh every token by what has landed since the last batch.

    Each batch merges its articles into the newest snapshot and commits the next one.  Its time
    is the newest time at which one of its landings was fetched, not before ``as_of`` and
    after the last snapshot, so a stream that runs for days follows the clock of its
    landings.  The commit names the batch: one that is retried after a crash is merged
    once, wherever the crash was.  Without an ``interval`` the stream stops when
    all that has landed is taken.  Landings have to say when they were fetched.
    """
    prepared = prepare_tokens(tokens, settings)

    def take(batch: DataFrame, number: int) -> None:
        # a checkpoint that is made anew numbers its batches anew, under another id
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
        batch = batch.persist()
        newest, earliest = batch.agg(F.max("fetched"), F.min(F.when(F.col("query_id").isNotNull(), F.col("fetched")))).first()
        commit_refresh(
            spark,
            settings,
            prepared,
            search=batch.filter("query_id is not null"),
            feeds=batch.filter("query_id is null"),
            landings=batch.select("landing").distinct(),
            earliest=earliest,
            snapshots=snapshots,
            published=published,
            as_of=max(as_of, newest or 0),
            batch=f"{stream}-{number}",
        )
        batch.unpersist()

    writer = (
        landed_articles(spark, search_path, feeds_path, max_files_per_trigger)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(take)
    )
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()
