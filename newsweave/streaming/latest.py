"""Incremental refresh as a stream: the newest row per key, late rows ignored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.articles import latest_articles
from ..schemas import ARTICLE_KEYS
from ..sources.snapshots import exists


def stream_articles(
    spark: SparkSession,
    path: str,
    schema: StructType,
    *,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Landed article files as a stream; the checkpoint knows which were taken."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


def latest_stream(
    articles: DataFrame,
    keys: Sequence[str] = ARTICLE_KEYS,
    *,
    arrival: str = "arrival",
    retention: str | None = None,
) -> DataFrame:
    """Running ``latest_articles`` of a stream (update mode).

    The state holds one row per key.  Where articles stop mattering after some time,
    ``retention`` bounds it: keys become keys per calendar day, and days older than
    the watermark are closed and emitted once (append mode also works then).
    """
    if retention is None:
        return latest_articles(articles, keys, arrival=arrival)
    timed = articles.withColumn(
        "event_time", F.timestamp_seconds(F.coalesce("timestamp", F.lit(0)))
    ).withWatermark("event_time", retention)
    rest = [c for c in articles.columns if c not in keys]
    order = F.struct(-F.coalesce("timestamp", F.lit(0)), F.col(arrival))
    return (
        timed.groupBy(F.window("event_time", "1 day").alias("day"), *keys)
        .agg(
            F.min_by(F.struct(*rest), order).alias("kept"),
            F.min(arrival).alias("first_arrival"),
        )
        .select("day", *keys, "kept.*", "first_arrival")
    )


def write_changes(
    latest: DataFrame,
    path: str,
    checkpoint: str,
    *,
    interval: str | None = None,
    mode: str = "update",
) -> StreamingQuery:
    """Write each batch's changed rows to ``<path>/batch=<n>/``.

    With no ``interval`` the stream takes what has arrived since the last run and
    stops; with one it keeps running.  A batch that is retried replaces its own folder,
    so a lost executor or a restart leaves no row twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = (
        latest.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def current_rows(
    spark: SparkSession, path: str, keys: Sequence[str] = ARTICLE_KEYS, *, arrival: str = "arrival"
) -> DataFrame:
    """The final state of the stream: the newest row per key, first among equals.

    By the rows' own times, not by when they came: a late row, or one of an older day
    that is closed later, changes nothing.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    changes = spark.read.option("basePath", path).parquet(path)
    keys = list(keys)
    rest = [c for c in changes.columns if c not in (*keys, "batch", "day", "first_arrival")]
    order = F.struct(-F.coalesce("timestamp", F.lit(0)), F.col(arrival))
    return (
        changes.groupBy(F.xxhash64(*keys).alias("_hash"), *keys)
        .agg(F.min_by(F.struct(*rest), order).alias("kept"), F.min("first_arrival").alias("first_arrival"))
        .select(*keys, "kept.*", "first_arrival")
    )


def compact_changes(
    spark: SparkSession, path: str, out: str, keys: Sequence[str] = ARTICLE_KEYS, *, arrival: str = "arrival"
) -> None:
    """Write the final state of ``path`` to ``out`` as one batch, for later runs to go on from.

    Their batches may be written beside it; ``path`` itself is left as it is.
    """
    newest = spark.read.option("basePath", path).parquet(path).agg(F.max("batch")).first()[0]
    current_rows(spark, path, keys, arrival=arrival).write.mode("overwrite").parquet(f"{out}/batch={newest}")
