"""Article queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.operators.articles import latest_articles, newest_first
from newsweave.plans.refresh import refresh

from . import sql
from .sql import q
from .views import AS_OF, DAY, TOKENS, as_of, keyed_documents, refresh_inputs

REFRESH_COLUMNS = [
    "token_key", "title", "link", "snippet", "source", "timestamp", "utc_time", "tag",
    "relevance", "pinned", "arrival_source", "arrival_item",
]


def _state(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    state = refresh(**refresh_inputs(spark, sf_dir), as_of=as_of(), strategy=strategy)
    return newest_first(state, token_key="token_key").select(
        *(c for c in REFRESH_COLUMNS if not c.startswith("arrival") and c != "pinned"),
        F.coalesce("pinned", F.lit(False)).alias("pinned"),
        F.col("first_arrival.source").alias("arrival_source"),
        F.col("first_arrival.item").alias("arrival_item"),
    )


def refresh_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir, "inline")


def refresh_articles_by_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir, "grams")


def _feeds_values() -> str:
    rows = [
        f"({q(t[1].lower())}, {i}, {q(tag)}, {q(url)})"
        for t in TOKENS
        for i, (tag, url) in enumerate(t[5])
    ]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") v(token_key, feed, tag, url)"


def _token_case(index: str) -> str:
    keys = sql.strings(t[1].lower() for t in TOKENS)
    return f"({keys})[({index}) + 1]"


REFRESH_INPUT_CTES = f"""
tokens AS ({sql.token_values()}),
feeds AS ({_feeds_values()}),
docs AS ({sql.CLEANED_DOCUMENTS}),
previous AS (
    SELECT {_token_case('doc_id % 3')} AS token_key, title, link, snippet, source,
           timestamp - {15 * DAY} AS timestamp, 'independent-news' AS tag, full_content,
           CASE WHEN doc_id % 4 = 0 THEN 10e0 END AS given, doc_id % 4 = 0 AS pinned,
           0 AS a_source, 0 AS a_list, doc_id AS a_item
    FROM docs WHERE doc_id % 5 = 0),
windows AS (
    SELECT t.token_key,
           coalesce(max(p.timestamp), {AS_OF} - 2 * 365 * {DAY}) AS start_ts
    FROM tokens t LEFT JOIN previous p USING (token_key) GROUP BY t.token_key),
search AS (
    SELECT {_token_case('doc_id % 4')} AS token_key, title, link, snippet, source, timestamp,
           'independent-news' AS tag, full_content, NULL::DOUBLE AS given, false AS pinned,
           1 AS a_source, 0 AS a_list, doc_id AS a_item
    FROM docs WHERE doc_id % 5 < 2),
windowed AS (
    SELECT s.* FROM search s JOIN windows w USING (token_key)
    WHERE make_timestamp(s.timestamp::BIGINT * 1000000)::DATE
          BETWEEN make_timestamp(w.start_ts::BIGINT * 1000000)::DATE
              AND make_timestamp({AS_OF}::BIGINT * 1000000)::DATE),
shared AS (
    SELECT title, link, snippet, source, timestamp + (doc_id % 2) * 50 - 20 AS timestamp,
           'independent-news' AS tag, full_content, NULL::DOUBLE AS given, false AS pinned,
           2 AS a_source, 0 AS a_list, doc_id AS a_item
    FROM docs WHERE doc_id % 5 <> 4),
own AS (
    SELECT f.token_key, title, link, snippet, source, timestamp, f.tag, full_content,
           10e0 AS given, true AS pinned, 3 AS a_source, f.feed AS a_list, doc_id AS a_item
    FROM docs JOIN feeds f ON f.url = 'feed' || (doc_id % 3) WHERE doc_id % 5 = 4)
"""

REFRESH_SQL = f"""
WITH {REFRESH_INPUT_CTES},
arrived AS (
    SELECT * FROM previous UNION ALL SELECT * FROM windowed
    UNION ALL SELECT t.token_key, s.* FROM shared s CROSS JOIN tokens t
    UNION ALL SELECT * FROM own),
ranked AS (
    SELECT *,
           row_number() OVER (PARTITION BY token_key, source, link, title
                              ORDER BY timestamp DESC, a_source, a_list, a_item) AS rn,
           min(struct_pack(a := a_source, b := a_list, c := a_item))
               OVER (PARTITION BY token_key, source, link, title) AS first_arrival
    FROM arrived),
kept AS (SELECT * FROM ranked WHERE rn = 1),
{sql.feature_ctes('kept')},
scored AS (
    SELECT x.*, threshold, {sql.scores()}
    FROM features x JOIN tokens USING (token_key)),
final AS (SELECT *, coalesce(given, {sql.SCORE}) AS relevance FROM scored)
SELECT token_key, title, link, snippet, source, timestamp::BIGINT AS timestamp,
       {sql.utc_text('timestamp')} AS utc_time, tag, relevance, pinned,
       first_arrival.a::INTEGER AS arrival_source, first_arrival.c::BIGINT AS arrival_item
FROM final WHERE relevance >= threshold
"""


def dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = latest_articles(keyed_documents(spark, sf_dir), arrival="doc_id")
    return kept.select(
        "source", "link", "title", "timestamp", F.col("doc_id").alias("kept_doc_id"),
        F.col("first_arrival").alias("first_doc_id"),
        F.length("full_content").cast("bigint").alias("n_chars"),
    )


DEDUP_SQL = f"""
SELECT source, link, title, timestamp, doc_id AS kept_doc_id, first_doc_id,
       length(full_content)::BIGINT AS n_chars
FROM (SELECT *,
             row_number() OVER (PARTITION BY source, link, title
                                ORDER BY timestamp DESC, doc_id) AS rn,
             min(doc_id) OVER (PARTITION BY source, link, title) AS first_doc_id
      FROM ({sql.KEYED_DOCUMENTS}))
WHERE rn = 1
"""

QUERIES = {
    "refresh_articles": (refresh_articles, REFRESH_SQL),
    "refresh_articles_by_grams": (refresh_articles_by_grams, REFRESH_SQL),
    "dedup_latest": (dedup_latest, DEDUP_SQL),
}
