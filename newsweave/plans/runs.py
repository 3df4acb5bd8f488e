"""Whole runs over landed files: what a scheduler or a cron entry calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.articles import within_fetch_window
from ..operators.registry import registry_report
from ..operators.tokens import prepare_tokens
from ..session import configure
from ..settings import Settings
from ..schemas import PAGE
from ..sources.commits import (
    LANDINGS,
    commit,
    commits,
    new_attempt,
    new_landings,
    newest,
    write_part,
)
from ..sources.landed import (
    feed_articles,
    read_candidates,
    read_feed_entries,
    read_networks,
    read_search,
    read_token_metadata,
    search_articles,
    token_search_articles,
)
from ..sources.registry_files import default_feed_urls, read_registry, write_registry
from ..sources.snapshots import (
    new_in_state,
    read_state,
    read_totals,
    totals_report,
    write_published,
    write_state,
)
from .publication import publication_dates
from .refresh import (
    default_feed_articles,
    previous_articles,
    refresh,
    token_feed_articles,
)
from .registry import look_up_candidates, with_lookups

FOREVER = 2**62


def known_marks(spark: SparkSession, snapshots: str, earliest: int | None) -> DataFrame:
    """``token_key, high_water, since, until`` of the snapshots that searches since ``earliest`` knew.

    Mostly that is the newest snapshot alone; more of them only where responses land late.
    """
    done = commits(spark, snapshots)
    parts = spark.createDataFrame([], "token_key string, high_water bigint, since bigint, until bigint")
    for this, after in zip(done, [*done[1:], None]):
        until = after.time if after else FOREVER
        if earliest is None or until > earliest:
            marks = read_totals(spark, this).drop("kept")
            parts = parts.unionByName(marks.withColumns({"since": F.lit(this.time), "until": F.lit(until)}))
    return parts


def commit_refresh(
    spark: SparkSession,
    settings: Settings,
    prepared: DataFrame,
    *,
    search: DataFrame,
    feeds: DataFrame,
    landings: DataFrame,
    earliest: int | None,
    snapshots: str,
    published: str,
    as_of: int,
    batch: str = "",
) -> tuple[DataFrame, DataFrame] | None:
    """Merge landed articles into the newest snapshot and commit the next one.

    Its time is ``as_of``, or the second after the newest snapshot's.  The state, the
    landings it took, the marks and the public files are written first, the commit last:
    wherever the job dies, a rerun gives the same.  A batch that is committed is left alone.
    Returns the report per token and the rows that are new, both read from what was written.
    """
    last = newest(spark, snapshots)
    if batch and any(c.batch == batch for c in commits(spark, snapshots)):
        return None
    now = as_of if last is None else max(as_of, last.time + 1)
    time = F.lit(now).cast("bigint")
    previous = read_state(spark, last)
    marks = known_marks(spark, snapshots, earliest)
    state = refresh(
        tokens=prepared,
        previous=previous_articles(previous),
        search=within_fetch_window(token_search_articles(search, prepared), prepared, marks, time),
        default_feed=default_feed_articles(feeds, default_feed_urls(spark, settings)),
        token_feed=token_feed_articles(feeds, prepared),
        as_of=time,
        windowed=True,
    )
    attempt = new_attempt()
    current = write_state(state, snapshots, attempt)
    write_part(landings, snapshots, attempt, LANDINGS)
    write_published(current, published, now, prepared)
    done = commit(spark, snapshots, attempt, now, batch)
    report = totals_report(read_totals(spark, done), read_totals(spark, last))
    return report, new_in_state(current, previous)


def _fetched(path: str) -> int | None:
    """When a landed file says it was fetched."""
    found = [p.split("=", 1)[1] for p in path.split("/") if p.startswith("fetched=")]
    return int(found[-1]) if found and found[-1].isdigit() else None


def run_refresh(
    spark: SparkSession,
    settings: Settings,
    tokens: DataFrame,
    *,
    search_path: str,
    feeds_path: str,
    snapshots: str,
    published: str,
    as_of: int,
) -> tuple[DataFrame, DataFrame]:
    """Refresh every token and write its snapshot and its public file.

    Reads the files that no committed run took, whenever they were fetched or landed.
    Their names go through the driver, as those of any scan do.
    Returns the report per token and the articles that are new in this run, both read
    from what was written, so nothing is computed twice.
    """
    configure(spark)
    now = F.lit(as_of).cast("bigint")
    files = {
        kind: new_landings(spark, path, snapshots).collect()
        for kind, path in (("search", search_path), ("feeds", feeds_path))
    }
    paths = {kind: [r.path for r in rows] for kind, rows in files.items()}
    fetched = [f for p in paths["search"] if (f := _fetched(p)) is not None]
    taken = [(r.landing,) for rows in files.values() for r in rows]
    return commit_refresh(
        spark,
        settings,
        prepare_tokens(tokens, settings),
        search=search_articles(read_search(spark, search_path, files=paths["search"]), now),
        feeds=feed_articles(read_feed_entries(spark, feeds_path, files=paths["feeds"]), now),
        landings=spark.createDataFrame(taken, "landing string"),
        earliest=min(fetched, default=None),
        snapshots=snapshots,
        published=published,
        as_of=as_of,
    )


def run_registry(
    spark: SparkSession,
    *,
    networks_path: str,
    candidates_path: str,
    metadata_path: str,
    registry_root: str,
    as_of: int,
) -> tuple[DataFrame, DataFrame]:
    """Grow the registry from landed candidates; returns the report and the failed lookups.

    The lookups are written beside the registry and read back, so nothing is computed twice.
    """
    configure(spark)
    registry = read_registry(spark, registry_root)
    lookups = look_up_candidates(
        read_networks(spark, networks_path),
        read_candidates(spark, candidates_path),
        read_token_metadata(spark, metadata_path),
        registry,
    )
    last = newest(spark, registry_root)
    now = as_of if last is None else max(as_of, last.time + 1)
    attempt = new_attempt()
    path = write_part(lookups, registry_root, attempt, "lookups")
    done = with_lookups(registry, spark.read.schema(lookups.schema).parquet(path))
    write_registry(done.registry, registry_root, now, attempt)
    return registry_report(read_registry(spark, registry_root), done.new_tokens), done.failed


def run_publication(spark: SparkSession, pages_path: str, out: str, as_of: int) -> None:
    """Dates of a Parquet table of pages, written beside it."""
    configure(spark)
    pages = spark.read.schema(PAGE).parquet(pages_path)
    publication_dates(pages, F.lit(as_of).cast("bigint")).write.parquet(out)
