"""Queries over files that Spark lands from the given tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.plans.runs import run_refresh
from newsweave.session import configure, shared_folder
from newsweave.settings import Settings
from newsweave.sources.commits import folder
from newsweave.sources.landed import (
    feed_articles,
    planned_queries,
    read_feed_entries,
    read_search,
    search_articles,
)
from newsweave.sources.commits import commits
from newsweave.sources.snapshots import (
    append_items,
    new_in_state,
    read_published,
    read_snapshot,
    read_state,
    read_totals,
    totals_report,
    write_published,
    write_snapshot,
)
from newsweave.plans.refresh import SEARCH, arrival
from newsweave.streaming.latest import (
    compact_changes,
    current_rows,
    latest_stream,
    stream_articles,
    write_changes,
)
from newsweave.streaming.refresh import refresh_stream

from . import sql
from .articles import DEDUP_SQL
from .views import AS_OF, DAY, _token_of, as_of, documents, keyed_documents, raw_token_rows, token_rows

PER_PAGE = 100
QUERIES_LANDED = 5


def _landed_search(spark: SparkSession, sf_dir: str) -> str:
    """Documents as search responses of 100 results; every fourth page is an error."""
    path = shared_folder(configure(spark), "search")
    doc = F.col("doc_id")
    result = F.struct(
        "doc_id", "title", "link", "snippet", "source",
        F.concat((doc % 30).cast("string"), F.lit(" days ago")).alias("date"),
    )
    page = F.floor(doc / (PER_PAGE * QUERIES_LANDED))
    pages = (
        documents(spark, sf_dir)
        .groupBy(
            F.concat(F.lit("q"), (doc % QUERIES_LANDED).cast("string")).alias("query_id"),
            page.alias("page"),
        )
        # a page holds at most 100 results
        .agg(F.array_sort(F.collect_list(result)).alias("r"))
    )
    fields = ["title", "link", "snippet", "source", "date"]
    failed = (F.col("page") + F.substring("query_id", 2, 9).cast("bigint")) % 4 == 3
    pages.select(
        "query_id",
        "page",
        F.when(failed, F.lit("quota exceeded")).alias("error"),
        F.transform("r", lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("news_results"),
        # even queries were fetched a day before the run, the others at an unknown time
        F.when(F.substring("query_id", 2, 9).cast("bigint") % 2 == 0, AS_OF - DAY).cast("bigint").alias("fetched"),
    ).write.partitionBy("query_id", "page", "fetched").json(path)
    return path


def landed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = read_search(spark, _landed_search(spark, sf_dir))
    return search_articles(responses, as_of()).select(
        "query_id", "page", F.col("item").cast("bigint").alias("item"),
        "title", "link", "snippet", "source", "timestamp", "utc_time", "tag",
    )


LANDED_SEARCH_SQL = f"""
WITH d AS (SELECT *, 'q' || (doc_id % {QUERIES_LANDED}) AS query_id,
                  (doc_id // {PER_PAGE * QUERIES_LANDED})::BIGINT AS page,
                  {AS_OF}::BIGINT - (doc_id % 30 + CASE WHEN doc_id % {QUERIES_LANDED} % 2 = 0 THEN 1 ELSE 0 END) * {DAY} AS ts
           FROM ({sql.CLEANED_DOCUMENTS}))
SELECT query_id, page,
       row_number() OVER (PARTITION BY query_id, page ORDER BY doc_id) - 1 AS item,
       title, link, snippet, source, ts::BIGINT AS timestamp, {sql.utc_text('ts')} AS utc_time,
       'independent-news' AS tag
FROM d WHERE (page + doc_id % {QUERIES_LANDED}) % 4 <> 3
"""

FEEDS = 6
PER_FETCH = 50


def _landed_feeds(spark: SparkSession, sf_dir: str) -> str:
    """Documents as feed documents of up to 50 entries: four RSS feeds, two Atom feeds.

    Feed 0 has no title; entries differ in how, and whether, they are dated.
    """
    path = shared_folder(configure(spark), "feeds")
    doc = F.col("doc_id")
    number = doc % FEEDS
    when = F.timestamp_seconds("timestamp")
    rfc = F.concat(F.date_format(when, "EEE, dd MMM yyyy HH:mm:ss"),
                   F.when(doc % 4 == 0, " GMT").otherwise(" +0200"))
    iso = F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    docs = documents(spark, sf_dir).withColumn("n", number)
    keys = [
        F.concat(F.lit("https://feed"), F.col("n").cast("string"), F.lit(".example/x?a=1")).alias("url"),
        F.floor(doc / (PER_FETCH * FEEDS)).alias("fetched"),
        F.when(F.col("n") > 0, F.concat(F.lit("Feed "), F.col("n").cast("string"))).alias("title"),
    ]

    def channel(rows: DataFrame, entry, name: str) -> DataFrame:
        # a fetch holds at most 50 entries
        listed = F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e"))))
        return (
            rows.groupBy(*keys).agg(listed.alias("l"))
            .select("url", "fetched", "title", F.transform("l", lambda x: x["e"]).alias(name))
        )

    rss = F.struct(
        F.concat(F.lit("R & "), doc.cast("string")).alias("title"),
        "link",
        F.concat(F.lit("<b>"), F.col("snippet"), F.lit("</b>")).alias("description"),
        F.when(doc % 5 > 0, rfc).alias("pubDate"),
    )
    atom = F.struct(
        F.concat(F.lit("A "), doc.cast("string")).alias("title"),
        F.array(
            F.struct(F.lit("/self").alias("_href"), F.lit("self").alias("_rel")),
            F.struct(F.col("link").alias("_href"), F.lit("alternate").alias("_rel")),
        ).alias("link"),
        F.col("snippet").alias("summary"),
        F.when(doc % 5 > 0, iso).alias("published"),
        iso.alias("updated"),
    )
    for rows, entry, name, root, tag in [
        (docs.filter("n < 4"), rss, "item", "rss", "channel"),
        (docs.filter("n >= 4"), atom, "entry", "feeds", "feed"),
    ]:
        (
            channel(rows, entry, name)
            .write.format("xml").option("rootTag", root).option("rowTag", tag)
            .partitionBy("url", "fetched").mode("append").save(path)
        )
    return path


def landed_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = read_feed_entries(spark, _landed_feeds(spark, sf_dir))
    return feed_articles(entries, as_of()).select(
        "url", "page", "item", "title", "link", "source", "timestamp", "utc_time", "tag",
        F.length("snippet").cast("bigint").alias("n_snippet"),
    )


LANDED_FEEDS_SQL = f"""
WITH d AS (SELECT *, doc_id % {FEEDS} AS n, (doc_id // {PER_FETCH * FEEDS})::BIGINT AS page FROM ({sql.CLEANED_DOCUMENTS})),
e AS (SELECT *, row_number() OVER (PARTITION BY n, page ORDER BY doc_id) - 1 AS item,
             CASE WHEN n >= 4 THEN timestamp WHEN doc_id % 5 = 0 THEN page
                  WHEN doc_id % 4 = 0 THEN timestamp ELSE timestamp - 7200 END::BIGINT AS ts
      FROM d)
SELECT 'https://feed' || n || '.example/x?a=1' AS url, page, item,
       CASE WHEN n < 4 THEN 'R & ' ELSE 'A ' END || doc_id AS title, link,
       CASE WHEN n = 0 THEN 'Unknown' ELSE 'Feed ' || n END AS source,
       ts AS timestamp, {sql.utc_text('ts')} AS utc_time, 'independent-news' AS tag,
       length(snippet)::BIGINT AS n_snippet
FROM e
"""


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return documents(spark, sf_dir).withColumns(
        {
            "token_key": F.concat(F.lit("k"), (doc % 3).cast("string")),
            "utc_time": F.lit("-"),
            "tag": F.lit("t"),
            "relevance": F.lit(10.0),
            "pinned": doc % 2 == 0,
            "first_arrival": arrival(SEARCH, F.lit(0), F.lit(0), doc),
        }
    )


def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots written, the newer one read back."""
    root = shared_folder(configure(spark), "snapshots")
    state = _state(spark, sf_dir)
    write_snapshot(state, root, AS_OF)
    write_snapshot(state.filter("doc_id % 4 > 0"), root, AS_OF + DAY)
    return read_snapshot(spark, root).select(
        "token_key", "title", "link", "source", "timestamp", "pinned",
        F.length("full_content").cast("bigint").alias("n_chars"),
    )


SNAPSHOT_SQL = f"""
SELECT 'k' || (doc_id % 3) AS token_key, title, link, source, timestamp, doc_id % 2 = 0 AS pinned,
       length(full_content)::BIGINT AS n_chars
FROM ({sql.DOCUMENTS}) WHERE doc_id % 4 > 0
"""


def snapshot_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a written snapshot that the one before it does not hold, with how many its token has of all."""
    root = shared_folder(configure(spark), "snapshots")
    state = _state(spark, sf_dir).withColumn("link", F.expr("CASE WHEN doc_id % 7 > 0 THEN link END"))
    write_snapshot(state.filter("doc_id % 4 > 0"), root, AS_OF)
    write_snapshot(state.filter("doc_id % 5 > 0"), root, AS_OF + DAY)
    before, after = commits(spark, root)
    report = totals_report(read_totals(spark, after), read_totals(spark, before))
    new = new_in_state(read_state(spark, after), read_state(spark, before))
    return new.join(report, "token_key").select("token_key", "title", "link", "source", "timestamp", "kept", "previous", "added")


SNAPSHOT_NEW_SQL = f"""
WITH d AS (SELECT * REPLACE (CASE WHEN doc_id % 7 > 0 THEN link END AS link), 'k' || (doc_id % 3) AS token_key
           FROM ({sql.DOCUMENTS})),
n AS (SELECT token_key, count(*) FILTER (doc_id % 5 > 0) AS kept, count(*) FILTER (doc_id % 4 > 0) AS previous FROM d GROUP BY 1)
SELECT c.token_key, title, link, source, timestamp, kept, previous, kept - previous AS added
FROM d c JOIN n USING (token_key)
WHERE doc_id % 5 > 0 AND NOT EXISTS (
    SELECT 1 FROM d p WHERE p.doc_id % 4 > 0 AND p.token_key = c.token_key
    AND p.source IS NOT DISTINCT FROM c.source AND p.link IS NOT DISTINCT FROM c.link
    AND p.title IS NOT DISTINCT FROM c.title)
"""


def published_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published files after a run for all tokens and a later one that leaves k0 without articles.

    A row without a title and link stands for a token's empty list.
    """
    root = shared_folder(configure(spark), "published")
    state = _state(spark, sf_dir).withColumn("position", F.col("doc_id"))
    tokens = spark.createDataFrame([("k0",), ("k1",), ("k2",), ("new",)], "token_key string")
    write_published(state, root, AS_OF, tokens)
    later = write_published(state.filter("token_key <> 'k0'"), root, AS_OF + DAY, tokens)
    columns = ["title", "link", "source", "timestamp", "tag", "token_key"]
    listed = spark.read.option("basePath", later).text(later)
    empty = listed.filter("value = ''").select(
        *(F.lit(0 if c == "timestamp" else "").alias(c) for c in columns[:-1]), "token_key"
    )
    return read_published(spark, root).select(*columns).unionByName(empty)


PUBLISHED_SQL = f"""
SELECT title, link, source, timestamp, 't' AS tag, 'k' || (doc_id % 3) AS token_key
FROM ({sql.DOCUMENTS}) WHERE doc_id % 3 <> 0
UNION ALL SELECT '', '', '', 0, '', k FROM (VALUES ('k0'), ('new')) v(k)
"""


TASK_DOCS = 50_000


def _land_articles(docs: DataFrame, path: str, at_least: int) -> int:
    """Land documents in a number of files that grows with them; returns it, a multiple of ``at_least``.

    No task writes, and so reads, more than some 50,000 documents.
    """
    files = at_least * max(1, -(-docs.count() // (at_least * TASK_DOCS)))
    docs.repartition(files, "doc_id").write.mode("append").json(path)
    return files


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents landed as JSON files and taken as a stream, a quarter of the files at a time."""
    root = shared_folder(configure(spark), "stream")
    fields = ["doc_id", "source", "link", "title", "timestamp", "full_content"]
    docs = keyed_documents(spark, sf_dir).select(*fields)
    landed = _land_articles(docs, f"{root}/landed", 8)
    arrived = stream_articles(spark, f"{root}/landed", docs.schema, max_files_per_trigger=landed // 4)
    slim = arrived.withColumn("n_chars", F.length("full_content").cast("bigint")).drop("full_content")
    write_changes(
        latest_stream(slim, arrival="doc_id"), f"{root}/changes", f"{root}/checkpoint"
    ).awaitTermination()
    return current_rows(spark, f"{root}/changes", arrival="doc_id").select(
        "source", "link", "title", "timestamp", F.col("doc_id").alias("kept_doc_id"),
        F.col("first_arrival").alias("first_doc_id"), "n_chars",
    )


def stream_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream with closed days: the newest documents arrive first, older days later."""
    root = shared_folder(configure(spark), "stream")
    fields = ["doc_id", "source", "link", "title", "timestamp", "full_content"]
    docs = keyed_documents(spark, sf_dir).select(*fields)
    for late in (False, True):
        part = docs.filter((F.col("timestamp") < 1705363200) == late)
        _land_articles(part, f"{root}/landed", 2)
        arrived = stream_articles(spark, f"{root}/landed", docs.schema)
        slim = arrived.withColumn("n_chars", F.length("full_content").cast("bigint")).drop("full_content")
        changes = latest_stream(slim, arrival="doc_id", retention="40 days")
        write_changes(changes, f"{root}/changes", f"{root}/checkpoint").awaitTermination()
    compact_changes(spark, f"{root}/changes", f"{root}/compact", arrival="doc_id")
    return current_rows(spark, f"{root}/compact", arrival="doc_id").select(
        "source", "link", "title", "timestamp", F.col("doc_id").alias("kept_doc_id"),
        F.col("first_arrival").alias("first_doc_id"), "n_chars",
    )


def appended_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended to one folder in two runs."""
    path = shared_folder(configure(spark), "items")
    docs = documents(spark, sf_dir).select("doc_id", "title", "link")
    for rest in (0, 1):
        append_items(docs.filter(F.col("doc_id") % 2 == rest), path)
    return spark.read.schema(docs.schema).json(path)


APPENDED_SQL = f"SELECT doc_id, title, link FROM ({sql.DOCUMENTS})"

def _day_of(spark: SparkSession, sf_dir: str, day: int) -> DataFrame:
    """The search responses of a day: each document is a result of its token's first query."""
    doc = F.col("doc_id")
    docs = documents(spark, sf_dir).filter(doc % DAYS == day).withColumns(
        {
            "token_key": _token_of(doc % 4),
            "date": F.concat((doc % 20).cast("string"), F.lit(" hours ago")),
            "page": F.floor(doc / (PER_PAGE * 4 * DAYS)),
            "fetched": F.lit(AS_OF + day * DAY + FETCH_HOUR * 3600),
        }
    )
    first = planned_queries(token_rows(spark)).filter("n_phrases = 0").select("token_key", "query_id")
    result = F.struct("doc_id", "title", "link", "snippet", "source", "date")
    fields = ["title", "link", "snippet", "source", "date"]
    return (
        docs.join(first, "token_key")
        .groupBy("query_id", "page", "fetched")
        # a page holds at most 100 results
        .agg(F.array_sort(F.collect_list(result)).alias("r"))
        .select("query_id", "page", "fetched", F.transform("r", lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("news_results"))
    )


def _land_day(spark: SparkSession, sf_dir: str, root: str, day: int) -> None:
    landed = _day_of(spark, sf_dir, day)
    landed.write.mode("append").partitionBy("query_id", "page", "fetched").json(f"{root}/search")
    feeds, files = folder(spark, f"{root}/feeds")
    files.mkdirs(feeds)  # no feed has landed yet


def _refresh_paths(root: str) -> dict[str, str]:
    return {
        "search_path": f"{root}/search", "feeds_path": f"{root}/feeds",
        "snapshots": f"{root}/snapshots", "published": f"{root}/published",
    }


def _kept(spark: SparkSession, root: str) -> DataFrame:
    return read_snapshot(spark, f"{root}/snapshots").select(
        "token_key", "title", "link", "source", "timestamp", "utc_time", "relevance"
    )


def stream_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refresh stream, taken up again after the landings of each of three days."""
    root = shared_folder(configure(spark), "refresh-stream")
    for day in range(DAYS):
        _land_day(spark, sf_dir, root, day)
        refresh_stream(
            spark, Settings(), raw_token_rows(spark), checkpoint=f"{root}/checkpoint", **_refresh_paths(root)
        ).awaitTermination()
    return _kept(spark, root)


def late_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: the responses of the second day land after the run that follows the third."""
    root = shared_folder(configure(spark), "refresh-late")
    for days in LATE:
        for day in days:
            _land_day(spark, sf_dir, root, day)
        as_of_run = AS_OF + (DAYS - 1 + LATE.index(days)) * DAY + 21 * 3600
        run_refresh(spark, Settings(), raw_token_rows(spark), as_of=as_of_run, **_refresh_paths(root))
    return _kept(spark, root)


DAYS, FETCH_HOUR = 3, 20
LATE = [(0, 2), (1,)]


def _steps_sql(steps) -> str:
    """What each step leaves: the newest row of a key among those kept and those that landed, if it scores."""
    kept = "SELECT * FROM s WHERE false"
    for days in steps:
        landed_ = f"SELECT * FROM s WHERE doc_id % {DAYS} IN ({', '.join(map(str, days))})"
        kept = f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY token_key, source, link, title ORDER BY ts DESC, doc_id) AS rn
  FROM ({kept} UNION ALL {landed_})) WHERE rn = 1 AND relevance >= threshold"""
    return f"""
WITH d AS (SELECT * REPLACE (NULL::VARCHAR AS full_content),
                  ({AS_OF} + doc_id % {DAYS} * {DAY} + ({FETCH_HOUR} - doc_id % 20) * 3600)::BIGINT AS ts
           FROM ({sql.CLEANED_DOCUMENTS})),
{sql.feature_ctes('d')},
p AS (SELECT x.*, token_key, threshold, {sql.scores()} FROM features x JOIN ({sql.token_values()}) t ON t.idx = x.doc_id % 4),
s AS MATERIALIZED (SELECT *, {sql.SCORE} AS relevance FROM p)
SELECT token_key, title, link, source, ts AS timestamp, {sql.utc_text('ts')} AS utc_time, relevance FROM ({kept})
"""


QUERIES = {
    "stream_refresh": (stream_refresh, _steps_sql([(0,), (1,), (2,)])),
    "late_landing": (late_landing, _steps_sql(LATE)),
    "stream_retention": (stream_retention, DEDUP_SQL),
    "appended_items": (appended_items, APPENDED_SQL),
    "landed_search": (landed_search, LANDED_SEARCH_SQL),
    "landed_feeds": (landed_feeds, LANDED_FEEDS_SQL),
    "snapshot_latest": (snapshot_latest, SNAPSHOT_SQL),
    "snapshot_new": (snapshot_new, SNAPSHOT_NEW_SQL),
    "published_json": (published_json, PUBLISHED_SQL),
    "stream_latest": (stream_latest, DEDUP_SQL),
}
