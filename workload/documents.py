"""Cleaning and scoring queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.functions.relevance import (
    content_relevance,
    final_score,
    normalise_phrases,
    sum_hits,
    text_relevance,
    words,
)
from newsweave.functions.columns import bind, with_computed
from newsweave.functions.text import clean_snippet, strip_tags, truncate
from newsweave.operators.articles import (
    article_day,
    articles_per_day,
    keep_relevant,
    with_day_bonus,
)
from newsweave.operators.matching import match_tokens

from . import sql
from .views import OPEN_TOKEN, TOKENS, documents, table, token_rows

KEYWORDS = ["Onenst", "Tionble", "stupid"]
PHRASES = ["ing", "therea", "ción", ""]


def _phrases(items: list[str]):
    return normalise_phrases(F.array(*map(F.lit, items)))


def _sql_phrases(items: list[str]) -> str:
    return sql.strings(i.lower() for i in items if i)


def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", clean_snippet("html").alias("snippet")
    )


CLEAN_SQL = f"""
WITH t AS (SELECT page_id, url, {sql.strip_tags(sql.unescape('html'))} AS x FROM pages)
SELECT page_id, url, {sql.truncate('x')} AS snippet FROM t
"""


def text_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.lower("text")
    measured = bind(
        words(lowered),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"),
            F.md5(F.array_join(w, " ")).alias("digest"),
        ),
    )
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", measured.alias("m")).select("doc_id", "m.*")


WORDS_SQL = f"""
WITH l AS (SELECT doc_id, lower(text) AS t FROM documents),
w AS (SELECT doc_id, {sql.words('t')} AS w FROM l)
SELECT doc_id, len(w)::BIGINT AS n_words, len(list_distinct(w))::BIGINT AS n_distinct,
       md5(array_to_string(w, ' ')) AS digest
FROM w
"""


def text_relevance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.lower("text")
    return docs.select(
        "doc_id",
        sum_hits(lowered, _phrases(KEYWORDS)).alias("keyword_hits"),
        sum_hits(lowered, _phrases(PHRASES)).alias("phrase_hits"),
        text_relevance("text", _phrases(KEYWORDS), _phrases(PHRASES)).alias("relevance"),
    )


TEXT_RELEVANCE_SQL = f"""
WITH l AS (SELECT doc_id, lower(text) AS t FROM documents),
w AS (SELECT doc_id, t, {sql.words('t')} AS w FROM l),
r AS (SELECT *, {sql.ratio_of('w')} AS r, {_sql_phrases(KEYWORDS)} AS keywords,
             {_sql_phrases(PHRASES)} AS phrases FROM w)
SELECT doc_id, {sql.hits('t', 'keywords')} AS keyword_hits,
       {sql.hits('t', 'phrases')} AS phrase_hits, {sql.weighted('t', 'r')} AS relevance
FROM r
"""


def content_relevance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full text present for two documents of three."""
    docs = documents(spark, sf_dir).withColumns(
        {
            "full_content": F.when(F.col("doc_id") % 3 > 0, F.col("full_content")),
            "snippet": truncate(strip_tags("snippet")),
        }
    )
    content = content_relevance(
        "title", "snippet", "full_content", _phrases(KEYWORDS), _phrases(PHRASES)
    )
    scored = with_computed(docs, "content", content)
    return scored.select("doc_id", "content", final_score(F.col("content"), F.lit(1.0)).alias("relevance"))


_PHRASE_ROW = (
    f"SELECT {_sql_phrases(KEYWORDS)} AS keywords, {_sql_phrases(PHRASES)} AS phrases"
)
CONTENT_RELEVANCE_SQL = f"""
WITH d AS (SELECT * REPLACE (CASE WHEN doc_id % 3 > 0 THEN full_content END AS full_content)
           FROM ({sql.CLEANED_DOCUMENTS})),
{sql.feature_ctes('d')},
s AS (SELECT *, {sql.scores()} FROM features CROSS JOIN ({_PHRASE_ROW}))
SELECT doc_id, {sql.CONTENT} AS content, {sql.SCORE} AS relevance FROM s
"""


def score_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the day bonus of the whole table, thresholded."""
    docs = documents(spark, sf_dir).withColumn("snippet", truncate(strip_tags("snippet")))
    content = content_relevance(
        "title", "snippet", "full_content", _phrases(KEYWORDS), _phrases(PHRASES)
    )
    scored = with_computed(
        with_day_bonus(docs), "relevance", final_score(content, F.col("bonus"))
    )
    return keep_relevant(scored, F.lit(6.5)).select(
        "doc_id", article_day().cast("string").alias("day"), "bonus", "relevance"
    )


SCORE_ARTICLES_SQL = f"""
WITH d AS ({sql.CLEANED_DOCUMENTS}),
days AS (SELECT make_timestamp(timestamp * 1000000)::DATE AS day,
                least(count(*)::DOUBLE, 5e0) AS bonus FROM d GROUP BY 1),
{sql.feature_ctes('d')},
s AS (SELECT *, {sql.scores()} FROM features CROSS JOIN ({_PHRASE_ROW})),
b AS (SELECT doc_id, day, bonus, {sql.final(sql.CONTENT, 'bonus')} AS relevance
      FROM s JOIN days ON day = make_timestamp(timestamp * 1000000)::DATE)
SELECT doc_id, day::VARCHAR AS day, bonus, relevance FROM b WHERE relevance >= 6.5e0
"""


def day_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp")
    )
    # a day on which few events fall, besides the busy ones
    sparse = F.when(F.col("timestamp") % 997 == 0, F.col("timestamp") + 40 * 86400)
    both = events.unionByName(events.select(sparse.alias("timestamp")))
    return articles_per_day(both).select(F.col("day").cast("string").alias("day"), "bonus")


DAY_BONUS_SQL = """
WITH e AS (SELECT floor(epoch(ts))::BIGINT AS x FROM events),
b AS (SELECT x FROM e UNION ALL SELECT x + 40 * 86400 FROM e WHERE x % 997 = 0)
SELECT make_timestamp(x * 1000000)::DATE::VARCHAR AS day,
       least(count(*)::DOUBLE, 5e0) AS bonus
FROM b GROUP BY 1
"""


def _match(spark: SparkSession, sf_dir: str, rows, strategy: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("arrival", F.col("doc_id"))
    matched = match_tokens(docs, token_rows(spark, rows), strategy=strategy)
    return matched.select("doc_id", "token_key", "relevance")


def _match_sql(rows) -> str:
    return f"""
WITH d AS ({sql.DOCUMENTS}), tokens AS ({sql.token_values(rows)}),
{sql.feature_ctes('d')},
s AS (SELECT *, {sql.scores()} FROM features CROSS JOIN tokens),
r AS (SELECT doc_id, token_key, threshold, {sql.SCORE} AS relevance FROM s)
SELECT doc_id, token_key, relevance FROM r WHERE relevance >= threshold
"""


def match_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, TOKENS, "inline")


def match_phrases_by_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, TOKENS, "grams")


def match_low_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, [*TOKENS[:2], OPEN_TOKEN], "inline")


def match_low_threshold_by_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, [*TOKENS[:2], OPEN_TOKEN], "grams")


def match_shared_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that share their arrival, as documents of one fetch may."""
    docs = documents(spark, sf_dir).withColumn("arrival", F.col("doc_id") % 3)
    return match_tokens(docs, token_rows(spark, TOKENS)).select("doc_id", "token_key", "relevance")


MATCH_SQL = _match_sql(TOKENS)
MATCH_LOW_SQL = _match_sql([*TOKENS[:2], OPEN_TOKEN])

QUERIES = {
    "clean_snippet": (clean_pages, CLEAN_SQL),
    "text_words": (text_words, WORDS_SQL),
    "text_relevance": (text_relevance_scores, TEXT_RELEVANCE_SQL),
    "content_relevance": (content_relevance_scores, CONTENT_RELEVANCE_SQL),
    "score_articles": (score_articles, SCORE_ARTICLES_SQL),
    "day_bonus": (day_bonus, DAY_BONUS_SQL),
    "match_phrases": (match_phrases, MATCH_SQL),
    "match_phrases_by_grams": (match_phrases_by_grams, MATCH_SQL),
    "match_shared_arrivals": (match_shared_arrivals, MATCH_SQL),
    "match_low_threshold": (match_low_threshold, MATCH_LOW_SQL),
    "match_low_threshold_by_grams": (match_low_threshold_by_grams, MATCH_LOW_SQL),
}
