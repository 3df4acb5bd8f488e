"""Article tables: de-duplication, filters, order, day counts, snapshot comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import join_spread
from ..functions.relevance import MAX_DAY_BONUS
from ..functions.text import clean_snippet
from ..schemas import ARTICLE_KEYS, PUBLISHED_FIELDS

DAY_SECONDS = 86400
# Calendar days exist for years 1 to 9999 only, so there are at most 3,652,059.
FIRST_SECOND, LAST_SECOND = -62135596800, 253402300799


def clean_articles(articles: DataFrame) -> DataFrame:
    """Decode, strip and truncate the snippet; missing title or snippet is ''."""
    return articles.withColumns(
        {
            "title": F.coalesce("title", F.lit("")),
            "snippet": clean_snippet("snippet"),
        }
    )


def latest_articles(
    articles: DataFrame,
    keys: Sequence[str] = ARTICLE_KEYS,
    *,
    arrival: str = "arrival",
    first_arrival: str = "first_arrival",
) -> DataFrame:
    """One row per key: the newest, the earliest arrival among equals.

    Null keys are equal to each other.  ``first_arrival`` is where the key was first
    seen, which is its place among articles of the same second.  An aggregate rather
    than a window: each map task reduces a hot key to one row before the shuffle.
    The leading hash makes the aggregate's sort compare integers, not long strings.
    """
    keys = list(keys)
    rest = [c for c in articles.columns if c not in keys and c != first_arrival]
    seen = first_arrival if first_arrival in articles.columns else arrival
    order = F.struct(-F.coalesce("timestamp", F.lit(0)), F.col(arrival))
    return (
        articles.groupBy(F.xxhash64(*keys).alias("_hash"), *keys)
        .agg(
            F.min_by(F.struct(*rest), order).alias("_kept"),
            F.min(seen).alias(first_arrival),
        )
        .select(*keys, "_kept.*", first_arrival)
    )


def keep_relevant(articles: DataFrame, threshold: Column | str) -> DataFrame:
    """Rows whose relevance (absent: 0) reaches the threshold."""
    threshold = F.col(threshold) if isinstance(threshold, str) else threshold
    return articles.filter(F.coalesce("relevance", F.lit(0.0)) >= threshold)


def newest_first(
    articles: DataFrame, *, token_key: str | None = None, first_arrival: str = "first_arrival"
) -> DataFrame:
    """Newest first, ties by first arrival; per token if ``token_key`` is given.

    A range sort: a token that owns a third of all rows spans many partitions.
    """
    lead = [F.col(token_key)] if token_key else []
    return articles.orderBy(*lead, F.desc("timestamp"), F.col(first_arrival))


def published(articles: DataFrame, *extra: str) -> DataFrame:
    """The public projection: no relevance, no bookkeeping."""
    return articles.select(*extra, *PUBLISHED_FIELDS)


def filter_and_sort(articles: DataFrame, threshold: Column | str) -> DataFrame:
    """Keep relevant rows, newest first, public columns."""
    return published(newest_first(keep_relevant(articles, threshold)))


def article_day(timestamp: Column | str = "timestamp") -> Column:
    """UTC calendar day of epoch seconds; null outside years 1 to 9999."""
    ts = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    day = F.to_date(F.timestamp_seconds(ts))
    return F.when(ts.between(FIRST_SECOND, LAST_SECOND), day)


def articles_per_day(articles: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """``day, bonus``: articles of each day, counted up to 5."""
    return (
        articles.select(article_day(timestamp).alias("day"))
        .filter("day is not null")
        .groupBy("day")
        .agg(
            F.least(F.count(F.lit(1)).cast("double"), F.lit(MAX_DAY_BONUS)).alias("bonus")
        )
    )


def with_day_bonus(articles: DataFrame) -> DataFrame:
    """Every article with its day's bonus, 0 for a time outside the calendar.

    The per-day table cannot outgrow the calendar (3.65 million short rows); a window per
    day would put a busy day into one task.
    """
    days = articles_per_day(articles).withColumnRenamed("day", "_day")
    return (
        articles.withColumn("_day", article_day())
        .join(days, "_day", "left")
        .withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))
        .drop("_day")
    )


def search_windows(tokens: DataFrame, previous: DataFrame, as_of: Column) -> DataFrame:
    """``token_key, start_ts, end_ts``: from the newest known article to ``as_of``.

    A token without a snapshot looks back its number of years, 365 days each.
    """
    marks = high_water_marks(previous)
    look_back = F.col("lookback_years").cast("bigint") * (365 * DAY_SECONDS)
    return (
        tokens.select("token_key", "lookback_years")
        .join(marks, "token_key", "left")
        .select(
            "token_key",
            F.coalesce("high_water", as_of - look_back).alias("start_ts"),
            as_of.alias("end_ts"),
        )
    )


def within_window(articles: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of each token dated inside its window, whole days at both ends."""
    day = article_day()
    dated = day.between(article_day("start_ts"), article_day("end_ts"))
    return join_spread(articles, windows, ["token_key"], articles.columns).filter(dated).drop("start_ts", "end_ts")


def high_water_marks(snapshot: DataFrame) -> DataFrame:
    """``token_key, high_water``: the newest article of each token."""
    return snapshot.groupBy("token_key").agg(F.max(F.coalesce("timestamp", F.lit(0))).alias("high_water"))


def within_fetch_window(articles: DataFrame, tokens: DataFrame, marks: DataFrame, as_of: Column) -> DataFrame:
    """Rows dated inside the window that their search asked for, whole days at both ends.

    A search goes from the mark of the newest snapshot before it to the time it was fetched;
    ``marks`` has ``high_water`` per token for times from ``since`` up to ``until``.  So a
    response that lands late is held against what was known when it was sent.
    """
    asked = F.coalesce("fetched", as_of)
    look_back = F.col("lookback_years").cast("bigint") * (365 * DAY_SECONDS)
    columns = articles.columns
    timed = articles.join(tokens.select("token_key", "lookback_years"), "token_key").withColumn("_asked", asked)
    known = (timed["token_key"] == marks["token_key"]) & (F.col("_asked") >= F.col("since")) & (F.col("_asked") < F.col("until"))
    start = F.coalesce("high_water", F.col("_asked") - look_back)
    dated = article_day().between(article_day(start), article_day("_asked"))
    return timed.join(marks, known, "left").filter(dated).select(*(timed[c] for c in columns)).drop("fetched")


def new_articles(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows of this refresh whose token and key the previous one did not hold."""
    keys = ["token_key", *ARTICLE_KEYS]
    old = previous.select(*(F.col(k).alias(f"_old_{k}") for k in keys))
    match = [F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in keys]
    return current.join(old, match, "left_anti")


def refresh_report(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Per token: rows kept, rows before, and the difference."""
    kept = current.groupBy("token_key").agg(F.count(F.lit(1)).alias("kept"))
    before = previous.groupBy("token_key").agg(F.count(F.lit(1)).alias("previous"))
    zero = F.lit(0).cast("bigint")
    return (
        kept.join(before, "token_key", "full")
        .select(
            "token_key",
            F.coalesce("kept", zero).alias("kept"),
            F.coalesce("previous", zero).alias("previous"),
        )
        .withColumn("added", F.col("kept") - F.col("previous"))
    )
