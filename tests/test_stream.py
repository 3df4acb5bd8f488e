import json

from pyspark.sql.types import LongType, StringType, StructField, StructType

from newsweave.operators.articles import latest_articles
from newsweave.streaming.latest import (
    compact_changes,
    current_rows,
    latest_stream,
    stream_articles,
    write_changes,
)
from test_articles import brute_latest, random_rows

FIELDS = ["source", "link", "title", "timestamp", "arrival"]
SCHEMA = StructType(
    [StructField(n, StringType() if n in FIELDS[:3] else LongType()) for n in FIELDS]
)


def land(path, name, rows):
    path.mkdir(parents=True, exist_ok=True)
    text = "\n".join(json.dumps(dict(zip(FIELDS, r))) for r in rows)
    (path / f"{name}.json").write_text(text, encoding="utf-8")


def run(spark, root, **options):
    arrived = stream_articles(spark, str(root / "in"), SCHEMA, max_files_per_trigger=1)
    stream = latest_stream(arrived, **options)
    write_changes(stream, str(root / "out"), str(root / "checkpoint")).awaitTermination()


def test_stream_ends_in_the_batch_state_across_restarts(spark, tmp_path):
    rows = random_rows(150, seed=9)
    # the newest rows come first, so late older rows must not replace them
    shuffled = sorted(rows, key=lambda r: -r[3])
    land(tmp_path / "in", "a", shuffled[:50])
    land(tmp_path / "in", "b", shuffled[50:100])
    run(spark, tmp_path)
    land(tmp_path / "in", "c", shuffled[100:])
    run(spark, tmp_path)
    run(spark, tmp_path)  # nothing new
    found = {tuple(r) for r in current_rows(spark, str(tmp_path / "out")).collect()}
    expected = brute_latest(rows)
    assert found == expected
    batch = latest_articles(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in batch.collect()} == expected


def test_retention_bounds_the_keys_to_days(spark, tmp_path):
    day = 86400
    land(tmp_path / "in", "a", [("s", "/", "t", 10 * day, 0), ("s", "/", "t", 10 * day + 5, 1)])
    run(spark, tmp_path, retention="1 day")
    land(tmp_path / "in", "b", [("s", "/", "t", 20 * day, 2)])
    run(spark, tmp_path, retention="1 day")
    land(tmp_path / "in", "c", [("s", "/", "t", 10 * day + 9, 3)])  # its day is closed
    run(spark, tmp_path, retention="1 day")
    changes = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    assert {r.arrival for r in changes.collect()} == {1, 2}


def test_late_rows_of_older_days_change_nothing(spark, tmp_path):
    day = 86400
    land(tmp_path / "in", "a", [("s", "/", "t", 20 * day, 5)])
    run(spark, tmp_path, retention="9 days")
    land(tmp_path / "in", "b", [("s", "/", "t", 19 * day, 3)])
    run(spark, tmp_path, retention="9 days")
    out = str(tmp_path / "out")
    compact_changes(spark, out, str(tmp_path / "small"))
    for path in (out, str(tmp_path / "small")):
        row = current_rows(spark, path).first()
        assert (row.timestamp, row.arrival, row.first_arrival) == (20 * day, 5, 3)


def test_feeds_can_be_taken_as_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from newsweave.sources.landed import feed_articles, read_feed_entries
    from test_sources import ATOM, RSS, put

    for name, text in [("a", RSS), ("b", ATOM)]:
        put(tmp_path / "in" / f"url={name}" / "fetched=1" / "d.xml", text)
    entries = read_feed_entries(spark, str(tmp_path / "in"), stream=True)
    articles = feed_articles(entries, F.lit(7).cast("bigint"))
    write_changes(
        articles, str(tmp_path / "out"), str(tmp_path / "checkpoint"), mode="append"
    ).awaitTermination()
    path = str(tmp_path / "out")
    found = spark.read.option("basePath", path).parquet(path).collect()
    assert {(r.title, r.timestamp) for r in found} == {
        ("A & B", 1733301000), ("No date", 1), ("E", 1733308200)
    }


def test_landed_files_grow_with_the_documents(spark, tmp_path, monkeypatch):
    from workload import landed

    monkeypatch.setattr(landed, "TASK_DOCS", 10)
    docs = spark.range(95).withColumnRenamed("id", "doc_id")
    assert landed._land_articles(docs, str(tmp_path / "many"), 2) == 10
    assert landed._land_articles(docs.limit(3), str(tmp_path / "few"), 2) == 2
    sizes = [len(f.read_text().splitlines()) for f in (tmp_path / "many").glob("*.json")]
    assert sum(sizes) == 95 and max(sizes) < 30
