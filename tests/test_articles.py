import random

from pyspark.sql import functions as F

from newsweave.operators.articles import (
    keep_relevant,
    latest_articles,
    new_articles,
    newest_first,
    refresh_report,
    search_windows,
    with_day_bonus,
)

SCHEMA = "source string, link string, title string, timestamp bigint, arrival bigint"


def random_rows(n=400, seed=5):
    rng = random.Random(seed)
    # one key holds a third of all rows
    return [
        ("hot", "/", "t", rng.randint(1, 20), i)
        if rng.random() < 0.33
        else (rng.choice(["a", None]), f"/{rng.randint(0, 9)}", rng.choice(["x", "y", None]), rng.randint(1, 20), i)
        for i in range(n)
    ]


def brute_latest(rows):
    kept = {}
    for row in rows:
        key = row[:3]
        if key not in kept or row[3] > kept[key][3]:
            kept[key] = row
    first = {}
    for row in rows:
        first.setdefault(row[:3], row[4])
    return {row + (first[key],) for key, row in kept.items()}


def test_latest_keeps_newest_then_earliest(spark):
    rows = random_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {tuple(r) for r in latest_articles(df).collect()} == brute_latest(rows)


def test_latest_of_latest_is_the_same(spark):
    """Reducing parts first must not change the outcome."""
    rows = random_rows(seed=6)
    df = spark.createDataFrame(rows, SCHEMA)
    parts = [latest_articles(df.filter(F.col("arrival") % 3 == i)) for i in range(3)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert {tuple(r) for r in latest_articles(merged).collect()} == brute_latest(rows)


def test_hot_keys_are_reduced_before_the_shuffle(spark):
    df = spark.createDataFrame(random_rows(), SCHEMA)
    plan = latest_articles(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min_by") >= 1 and "Window" not in plan


def test_order_is_newest_first_then_first_arrival(spark):
    rows = [("s", "/", str(i), ts, i) for i, ts in enumerate([5, 9, 5, 9, 7])]
    df = latest_articles(spark.createDataFrame(rows, SCHEMA))
    assert [r.arrival for r in newest_first(df).collect()] == [1, 3, 4, 0, 2]


def test_threshold_is_inclusive_and_absent_is_zero(spark):
    df = spark.createDataFrame([(1, 6.5), (2, 6.49), (3, None)], "i int, relevance double")
    assert [r.i for r in keep_relevant(df, F.lit(6.5)).collect()] == [1]
    assert keep_relevant(df, F.lit(0.0)).count() == 3


def test_day_bonus_is_capped_and_zero_outside_the_calendar(spark):
    rows = [(i, 1704067200 + i) for i in range(7)] + [(7, 1704067200 + 90000), (8, 10**15), (9, None)]
    df = spark.createDataFrame(rows, "i int, timestamp bigint")
    bonus = {r.i: r.bonus for r in with_day_bonus(df).collect()}
    assert bonus == {**{i: 5.0 for i in range(7)}, 7: 1.0, 8: 0.0, 9: 0.0}


def test_windows_start_at_the_newest_known_article(spark):
    tokens = spark.createDataFrame([("a", 2), ("b", 1)], "token_key string, lookback_years int")
    previous = spark.createDataFrame([("a", 5), ("a", None), ("a", 9)], "token_key string, timestamp bigint")
    as_of = F.lit(10**9).cast("bigint")
    found = {r.token_key: r.start_ts for r in search_windows(tokens, previous, as_of).collect()}
    assert found == {"a": 9, "b": 10**9 - 365 * 86400}


def test_new_articles_compare_null_keys(spark):
    schema = "token_key string, source string, link string, title string"
    current = spark.createDataFrame([("k", None, "/a", None), ("k", "s", "/b", "t"), ("l", None, "/a", None)], schema)
    previous = spark.createDataFrame([("k", None, "/a", None)], schema)
    found = {(r.token_key, r.link) for r in new_articles(current, previous).collect()}
    assert found == {("k", "/b"), ("l", "/a")}


def test_report_counts_both_sides(spark):
    current = spark.createDataFrame([("a",), ("a",), ("b",)], "token_key string")
    previous = spark.createDataFrame([("a",), ("c",)], "token_key string")
    found = {tuple(r) for r in refresh_report(current, previous).collect()}
    assert found == {("a", 2, 1, 1), ("b", 1, 0, 1), ("c", 0, 1, -1)}
