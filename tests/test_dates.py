from datetime import datetime, timezone

from pyspark.sql import functions as F

from newsweave.functions.dates import absolute_epoch, feed_epoch, parse_date
from newsweave.functions.pages import publication_date

NOW = 1735689600  # 2025-01-01


def as_of():
    return F.lit(NOW).cast("bigint")

DAY = 86400


def epoch(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp())


def test_relative_dates(column):
    cases = {
        "30 seconds ago": NOW - 30,
        "1 minute ago": NOW - 60,
        "2 hours ago": NOW - 7200,
        "3 Days Ago": NOW - 3 * DAY,
        "2 weeks ago": NOW - 14 * DAY,
        "5 months ago": NOW - 150 * DAY,
        "1 year ago": NOW - 365 * DAY,
        "ago 3 hours": NOW - 3 * 3600,
        "قبل ٣ ساعات": NOW - 3 * 3600,
    }
    read = parse_date("t", as_of())
    assert [x.timestamp for x in column(list(cases), read)] == list(cases.values())
    assert {x.date_source for x in column(list(cases), read)} == {"relative"}


def test_unreadable_dates_fall_back(column):
    texts = ["moments ago", "Chicago 3 days", "", None, "31/02/2024", "99999999999999 years ago"]
    for x in column(texts, parse_date("t", as_of())):
        assert (x.timestamp, x.date_source) == (NOW, "fallback")


def test_absolute_dates(column):
    cases = {
        "2024-12-04T10:30:00+02:00": epoch(2024, 12, 4, 8, 30),
        "2024-12-04": epoch(2024, 12, 4),
        "03/04/2024": epoch(2024, 3, 4),
        "13/04/2024": epoch(2024, 4, 13),
        "4 Dec 2024": epoch(2024, 12, 4),
        "4 December 2024": epoch(2024, 12, 4),
        "December 4, 2024": epoch(2024, 12, 4),
        "posted Dec. 4th, 2024 at 12:05 am": epoch(2024, 12, 4, 0, 5),
        "20241204T101112Z": epoch(2024, 12, 4, 10, 11, 12),
        "٤ ديسمبر ٢٠٢٤": epoch(2024, 12, 4),
    }
    found = column(list(cases), parse_date("t", as_of()))
    assert [x.timestamp for x in found] == list(cases.values())


def test_offsets_can_be_ignored(column):
    texts = ["2024-12-04T10:30:00+02:00", "Wed, 04 Dec 2024 10:30:00 EST"]
    assert column(texts, absolute_epoch("t", ignore_offset=True)) == [epoch(2024, 12, 4, 10, 30)] * 2
    assert column(texts, absolute_epoch("t")) == [epoch(2024, 12, 4, 8, 30), epoch(2024, 12, 4, 15, 30)]


def test_strict_reading_wants_nothing_else(column):
    texts = ["2024-12-04", "on 4 Dec 2024", "seen 2024-12-04", "Wed, 04 Dec 2024 10:30:00 GMT"]
    found = column(texts, absolute_epoch("t", strict=True))
    assert [x is not None for x in found] == [True, True, False, True]


def test_feed_dates(spark):
    rows = [
        ("Wed, 04 Dec 2024 10:30:00 GMT", None, epoch(2024, 12, 4, 10, 30)),
        ("Wed, 04 Dec 2024 10:30:00 +0200", None, epoch(2024, 12, 4, 8, 30)),
        (None, "2024-12-04T10:30:00Z", epoch(2024, 12, 4, 10, 30)),
        ("garbage", "2024-12-05", epoch(2024, 12, 5)),
        (None, None, NOW),
    ]
    df = spark.createDataFrame(rows, "p string, u string, e bigint")
    for r in df.select("e", feed_epoch("p", "u", as_of()).alias("x")).collect():
        assert r.x == r.e


PAGES = {
    '<meta property="article:published_time" content="2024-12-04T10:00:00Z">': ("meta", epoch(2024, 12, 4, 10)),
    "<meta content='2024-12-05' name='pubdate'/>": ("meta", epoch(2024, 12, 5)),
    '<META NAME="publication_date" CONTENT="5 December 2024">': ("meta", epoch(2024, 12, 5)),
    "<meta name=date content=20241206>": ("meta", epoch(2024, 12, 6)),
    '<meta itemprop="datePublished" content="2024-12-07">': ("meta", epoch(2024, 12, 7)),
    '<meta name="date" content="2024-12-02"><meta name="pubdate" content="2024-12-01">': ("meta", epoch(2024, 12, 1)),
    '<meta name="date" content="soon"><p>3 days ago</p>': ("text", NOW - 3 * DAY),
    '<script type="application/ld+json">{"uploadDate":"2024-12-08"}</script>': ("json-ld", epoch(2024, 12, 8)),
    '<script type="application/ld+json">[{"datePublished":"2024-12-08"}]</script>': None,
    '<script type="application/ld+json">{bad</script>'
    '<script type=\'application/ld+json\'>{"datePublished":"2024-12-10"}</script>': ("json-ld", epoch(2024, 12, 10)),
    "<script>2024-01-01</script><p>10 December 2024</p>": ("text", epoch(2024, 12, 10)),
    "<p>Posted <b>2024</b>-12-11</p>": ("text", epoch(2024, 12, 11)),
    "<p>Dec 9, 2024 and 2024-12-12</p>": ("text", epoch(2024, 12, 12)),
    "<p>December 4, 2024</p>": ("text", epoch(2024, 12, 4)),
    "<!-- 2024-12-04 --><p>nothing</p>": None,
}


def test_publication_dates(column):
    found = column(list(PAGES), publication_date("t", as_of()))
    assert [x and (x.date_source, x.epoch) for x in found] == list(PAGES.values())


def test_parts_left_out_come_from_the_reference_time(column):
    texts = ["Dec 4", "4 December, by us", "updated December 2024", "12/04/24", "25/12/99", "Wed, 04 Dec 24 10:30:00 GMT", "4 Dec 10:30", "Feb 30"]
    now = epoch(2025, 1, 31)
    read = column(texts, parse_date("t", F.lit(now).cast("bigint")))
    assert [x.timestamp for x in read] == [
        epoch(2025, 12, 4), epoch(2025, 12, 4), epoch(2024, 12, 31), epoch(2024, 12, 4), epoch(1999, 12, 25),
        epoch(2024, 12, 4, 10, 30), epoch(2025, 12, 4, 10, 30), now,
    ]
    assert column(texts[:3], absolute_epoch("t")) == [None] * 3
