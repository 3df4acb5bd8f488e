"""Date queries over events and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.functions import pages
from newsweave.functions.arabic import is_arabic, translate_date
from newsweave.functions.columns import with_computed
from newsweave.functions.dates import absolute_epoch, parse_date
from newsweave.functions.text import utc_text
from newsweave.functions.wordlists import (
    ARABIC_DIGITS,
    ARABIC_MONTHS,
    ARABIC_TIME_WORDS,
    ASCII_DIGITS,
    META_DATE_TAGS,
    UNIT_SECONDS,
)
from newsweave.plans.publication import publication_dates

from . import sql
from .sql import AS_OF, q
from .views import as_of, table

NO_DATE = -1
UNITS = list(UNIT_SECONDS)
ARABIC_UNITS = list(ARABIC_TIME_WORDS)[:21]
ARABIC_AGO = "قبل"


def _literal_array(items) -> Column:
    return F.array(*map(F.lit, items))


def _parsed(texts: DataFrame, *extra: str) -> DataFrame:
    dated = with_computed(texts, "d", parse_date("text", as_of()))
    return dated.select(
        "event_id",
        "text",
        translate_date("text").alias("translated"),
        "d.timestamp",
        "d.date_source",
        utc_text("d.timestamp").alias("utc_time"),
        *extra,
    )


def _parsed_sql(texts: str) -> str:
    return f"""
WITH src AS ({texts}), {sql.parsed_dates('src', 'text')}
SELECT event_id, text, translated, coalesce(epoch, {AS_OF})::BIGINT AS timestamp,
       {sql.DATE_SOURCE} AS date_source,
       {sql.utc_text(f'coalesce(epoch, {AS_OF})')} AS utc_time
FROM parsed
"""


def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit; also no number, a glued "ago", and a word that merely holds it."""
    e = F.col("event_id")
    unit = F.get(_literal_array(UNITS), (e % 7).cast("int"))
    text = (
        F.when(e % 13 == 0, F.concat(F.lit("Chicago "), (e % 30).cast("string"), F.lit(" days")))
        .when(e % 17 == 0, F.lit("moments ago"))
        .when(e % 19 == 0, F.concat(F.lit("ago"), (e % 30).cast("string"), F.lit(" "), unit))
        .otherwise(
            F.concat(
                (e % 30).cast("string"), F.lit(" "), unit,
                F.when(e % 2 == 0, "s ago").otherwise(" ago"),
            )
        )
    )
    return _parsed(table(spark, sf_dir, "events").select("event_id", text.alias("text")))


_UNIT_SIZES = "[1, 60, 3600, 86400, 604800, 2592000, 31536000]"
_PLAIN = "event_id % 13 <> 0 AND event_id % 17 <> 0"
# from the event's number alone: no pattern reads the text here
RELATIVE_SQL = f"""
SELECT event_id, text, text AS translated, timestamp, date_source,
       {sql.utc_text('timestamp')} AS utc_time
FROM (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'Chicago ' || (event_id % 30) || ' days'
             WHEN event_id % 17 = 0 THEN 'moments ago'
             WHEN event_id % 19 = 0 THEN 'ago' || (event_id % 30) || ' ' || unit
             ELSE (event_id % 30) || ' ' || unit || CASE WHEN event_id % 2 = 0 THEN 's ago' ELSE ' ago' END END AS text,
             ({AS_OF} - CASE WHEN {_PLAIN} THEN (event_id % 30) * size ELSE 0 END)::BIGINT AS timestamp,
             CASE WHEN {_PLAIN} THEN 'relative' ELSE 'fallback' END AS date_source
      FROM (SELECT event_id, ({sql.strings(UNITS)})[event_id % 7 + 1] AS unit,
                   {_UNIT_SIZES}[event_id % 7 + 1] AS size FROM events))
"""

# written forms: (Spark date pattern, SQL date pattern, text before, text after)
FORMS = [
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", "", "+02:00"),
    ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M", "", ""),
    ("MM/dd/yyyy", "%m/%d/%Y", "", ""),
    ("dd/MM/yyyy", "%d/%m/%Y", "", ""),
    ("MMM d, yyyy", "%b %-d, %Y", "Published ", " by us"),
    ("d MMMM yyyy", "%-d %B %Y", "", ""),
    ("MMMM d, yyyy", "%B %-d, %Y", "on ", " at 3:05 pm"),
    ("dd MMM yyyy HH:mm:ss", "%d %b %Y %H:%M:%S", "Mon, ", " GMT"),
    ("dd MMM yyyy HH:mm:ss", "%d %b %Y %H:%M:%S", "Tue, ", " -0530"),
    ("yyyyMMdd'T'HHmmss", "%Y%m%dT%H%M%S", "", "Z"),
    ("dd MMM yyyy HH:mm", "%d %b %Y %H:%M", "", " EST"),
    ("yyyy-02-30", "%Y-02-30", "", ""),
    ("MMM d", "%b %-d", "", ""),
    ("MM/dd/yy", "%m/%d/%y", "", ""),
    ("dd MMM yy HH:mm", "%d %b %y %H:%M", "", " GMT"),
    ("MMMM yyyy", "%B %Y", "in ", ""),
]


def absolute_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    pick = F.col("event_id") % len(FORMS)
    text = F.lit("")
    for i, (pattern, _, before, after) in enumerate(FORMS):
        written = F.concat(F.lit(before), F.date_format(ts, pattern), F.lit(after))
        text = F.when(pick == i, written).otherwise(text)
    texts = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    for name, options in (("wall_time", {"ignore_offset": True}), ("exact", {"strict": True})):
        texts = with_computed(texts, name, F.coalesce(absolute_epoch("text", **options), F.lit(NO_DATE)))
    return _parsed(texts, "wall_time", "exact")


def _form_case() -> str:
    whens = " ".join(
        f"WHEN {i} THEN {q(before)} || strftime(ts, {q(pattern)}) || {q(after)}"
        for i, (_, pattern, before, after) in enumerate(FORMS)
    )
    return f"CASE event_id % {len(FORMS)} {whens} END"


# epoch, wall time and strict reading of each form, from ts alone; null: not readable
_EXPECTED = [
    ("s - 7200", "s", "s - 7200"),
    ("m", "m", "m"),
    ("d", "d", "d"),
    ("swapped", "swapped", "swapped"),
    ("d", "d", "NULL"),
    ("d", "d", "d"),
    ("d + 54300", "d + 54300", "d + 54300"),
    ("s", "s", "s"),
    ("s + 19800", "s", "s + 19800"),
    ("s", "s", "s"),
    ("m + 18000", "m", "m + 18000"),
    ("NULL", "NULL", "NULL"),
    ("this_year", "NULL", "NULL"),
    ("d", "d", "d"),
    ("m", "m", "m"),
    ("month", "NULL", "NULL"),
]


def _expected(which: int) -> str:
    whens = " ".join(f"WHEN {i} THEN {row[which]}" for i, row in enumerate(_EXPECTED))
    return f"(CASE event_id % {len(FORMS)} {whens} END)"


ABSOLUTE_SQL = f"""
WITH t AS (
    SELECT event_id, {_form_case()} AS text, epoch(date_trunc('second', ts))::BIGINT AS s,
           epoch(date_trunc('minute', ts))::BIGINT AS m, epoch(date_trunc('day', ts))::BIGINT AS d,
           -- day first is read as month first where it can be
           epoch(CASE WHEN day(ts) > 12 THEN date_trunc('day', ts)
                      ELSE make_date(year(ts), day(ts), month(ts))::TIMESTAMP END)::BIGINT AS swapped,
           -- the run's day is the first of a month in a leap year
           epoch(make_date(2024, month(ts), day(ts))::TIMESTAMP)::BIGINT AS this_year,
           epoch(date_trunc('month', ts))::BIGINT AS month
    FROM events)
SELECT event_id, text, text AS translated, coalesce({_expected(0)}, {AS_OF})::BIGINT AS timestamp,
       CASE WHEN {_expected(0)} IS NULL THEN 'fallback' ELSE 'absolute' END AS date_source,
       {sql.utc_text(f'coalesce({_expected(0)}, {AS_OF})')} AS utc_time,
       coalesce({_expected(1)}, {NO_DATE})::BIGINT AS wall_time,
       coalesce({_expected(2)}, {NO_DATE})::BIGINT AS exact
FROM t
"""


def arabic_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events: day, month name and year; odd ones: "ago", number and unit."""
    e, ts = F.col("event_id"), F.col("ts").cast("timestamp")

    def digits(c: Column) -> Column:
        return F.translate(c.cast("string"), ASCII_DIGITS, ARABIC_DIGITS)

    month = F.get(_literal_array(ARABIC_MONTHS), F.month(ts) - 1 + (e % 11).cast("int"))
    unit = F.get(_literal_array(ARABIC_UNITS), (e % 21).cast("int"))
    space = F.lit(" ")
    absolute = F.concat(digits(F.dayofmonth(ts)), space, month, space, digits(F.year(ts)))
    relative = F.concat(F.lit(ARABIC_AGO), space, digits(e % 30), space, unit)
    texts = table(spark, sf_dir, "events").select(
        "event_id", F.when(e % 2 == 0, absolute).otherwise(relative).alias("text")
    )
    return _parsed(texts).withColumn("arabic", is_arabic("text"))


def _arabic_digits(c: str) -> str:
    return f"translate(({c})::VARCHAR, {q(ASCII_DIGITS)}, {q(ARABIC_DIGITS)})"


_ARABIC_TEXT = f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN
    {_arabic_digits('day(ts)')} || ' ' || ({sql.strings(ARABIC_MONTHS)})[month(ts) + event_id % 11]
    || ' ' || {_arabic_digits('year(ts)')}
    ELSE {q(ARABIC_AGO)} || ' ' || {_arabic_digits('event_id % 30')} || ' '
    || ({sql.strings(ARABIC_UNITS)})[event_id % 21 + 1] END AS text FROM events"""
ARABIC_SQL = f"SELECT *, true AS arabic FROM ({_parsed_sql(_ARABIC_TEXT)})"


# -- pages -------------------------------------------------------------------------


def _written(page: str = "page_id") -> str:
    """A day of 2024 in ISO form, from the page number, in both dialects."""
    return f"date_add(DATE '2024-01-01', CAST({page} % 300 AS INT))"


# what is put before a page, by page number modulo the list; {d} is an ISO date
SNIPPETS = [
    '<meta property="article:published_time" content="{d}T10:30:00+02:00">',
    "<meta content='{d}' name='pubdate'>",
    '<meta name="date" content="soon"><meta itemprop="datePublished" content="{d}">',
    '<script type="application/ld+json">{"@type":"News","datePublished":"{d}"}</script>',
    '<script type="application/ld+json">[{"uploadDate":"{d}"}]</script>',
    '<script type="application/ld+json">{bad</script>'
    '<script type="application/ld+json">{"datePublished":"","uploadDate":"{d}"}</script>',
    "<p>Posted <b>{d}</b> here</p>",
    "<p>5 days ago</p>",
    "<p>on 02/30/2024, or 4 December 2023</p>",
    "<p>updated December 4, 2023</p>",
    "<p>Mar&nbsp;7, 2024</p>",
    "<!-- <meta name=date content={d}> -->",
    "",
]


def dated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.col("page_id") % len(SNIPPETS)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int"))
    lead = F.lit("")
    for i, snippet in enumerate(SNIPPETS):
        lead = F.when(pick == i, F.lit(snippet)).otherwise(lead)
    lead = F.replace(lead, F.lit("{d}"), day.cast("string"))
    return table(spark, sf_dir, "pages").withColumn("html", F.concat(lead, "html"))


def publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = publication_dates(dated_pages(spark, sf_dir), as_of())
    return found.withColumn("epoch", F.coalesce("epoch", F.lit(NO_DATE)))


def _publication_sql() -> str:
    whens = " ".join(f"WHEN {i} THEN {q(s)}" for i, s in enumerate(SNIPPETS))
    day = "(DATE '2024-01-01' + (page_id % 300)::INTEGER)::VARCHAR"
    tag_texts = []
    for attribute, value in META_DATE_TAGS:
        first = (
            f"list_filter(tags, lambda t: regexp_matches(t, {q(pages.meta_tag(attribute, value))}))[1]"
        )
        tag_texts.append(
            "coalesce(" + " || ".join(
                f"regexp_extract({first}, {q(pages.CONTENT)}, {g})" for g in (1, 2, 3)
            ) + ", '')"
        )
    body_date = (
        "coalesce(nullif(json_extract_string(j, '$.datePublished'), ''), "
        "nullif(json_extract_string(j, '$.uploadDate'), ''), '')"
    )
    visible = (
        f"replace(regexp_replace(regexp_replace(page, {q(pages.UNSEEN)}, '', 'g'), "
        f"{q(pages.TAG)}, '', 'g'), '&nbsp;', ' ')"
    )
    forms = [pages.ISO, pages.SLASHED, pages.SHORT_MONTH_DAY, pages.DAY_LONG_MONTH]

    def candidates(items) -> str:
        return "[" + ", ".join(items) + "]"

    found = [f"regexp_extract(body, {q(p)}, 0)" for p in forms]
    return f"""
WITH lead AS (SELECT page_id, url, html, CASE page_id % {len(SNIPPETS)} {whens} END AS l FROM pages),
p AS (SELECT page_id, url,
             regexp_replace(replace(l, '{{d}}', {day}) || html, {q(pages.COMMENT)}, '', 'g') AS page
      FROM lead),
parts AS (SELECT page_id, url, regexp_extract_all(page, {q(pages.META)}) AS tags,
                 list_transform(regexp_extract_all(page, {q(pages.JSON_LD)}, 1),
                                lambda b: try_cast(b AS JSON)) AS scripts,
                 {visible} AS body
          FROM p),
texts AS (SELECT page_id, url, {candidates(tag_texts)} AS meta_texts,
                 list_transform(scripts, lambda j: {body_date}) AS json_texts,
                 {candidates(found)} AS forms,
                 regexp_extract(body, {q(pages.TIME_AGO)}, 0) AS ago,
                 [regexp_extract(body, {q(pages.LONG_MONTH_DAY)}, 0)] AS long_form
          FROM parts),
items AS (
    SELECT page_id, 1 AS kind, 'meta' AS date_source, unnest(meta_texts) AS x,
           generate_subscripts(meta_texts, 1) AS i FROM texts
    UNION ALL SELECT page_id, 2, 'json-ld', unnest(json_texts), generate_subscripts(json_texts, 1)
    FROM texts
    UNION ALL SELECT page_id, 3, 'text', unnest(forms), generate_subscripts(forms, 1) FROM texts
    UNION ALL SELECT page_id, 4, 'text', ago, 1 FROM texts
    UNION ALL SELECT page_id, 5, 'text', unnest(long_form), 1 FROM texts),
low AS (SELECT *, lower(x) AS low FROM items),
dated AS (SELECT *, CASE WHEN kind = 4 THEN {sql.relative('low')}
                         ELSE {sql.absolute('low', strict=True)} END AS epoch
          FROM low),
best AS (SELECT page_id, arg_min(epoch, kind * 1000 + i) AS epoch,
                arg_min(date_source, kind * 1000 + i) AS date_source
         FROM dated WHERE epoch IS NOT NULL GROUP BY page_id)
SELECT p.page_id, p.url, coalesce(epoch, {NO_DATE})::BIGINT AS epoch, date_source
FROM p LEFT JOIN best USING (page_id)
"""


QUERIES = {
    "relative_dates": (relative_dates, RELATIVE_SQL),
    "absolute_dates": (absolute_dates, ABSOLUTE_SQL),
    "arabic_dates": (arabic_dates, ARABIC_SQL),
    "publication_dates": (publication, _publication_sql()),
}
