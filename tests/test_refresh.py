from pyspark.sql import functions as F

from newsweave.operators.tokens import prepare_tokens
from newsweave.plans.refresh import (
    DEFAULT_FEED,
    SEARCH,
    TOKEN_FEED,
    arrival,
    as_articles,
    previous_articles,
    refresh,
)
from newsweave.schemas import SNAPSHOT, TOKEN
from newsweave.sources.snapshots import read_snapshot, write_snapshot

NOW = 1735689600
DAY = 86400


def as_of(now=NOW):
    return F.lit(now).cast("bigint")


def registry(spark):
    rows = [
        ("Lido", "LDO", {"c": "0x1"}, 2, None, ["lido"], ["defi"], [("dao", "u1")]),
        ("Other", "OTH", {"c": "0x2"}, 1, 8.0, [], ["defi"], None),
    ]
    return prepare_tokens(
        spark.createDataFrame(rows, TOKEN).withColumn("token_key", F.lower("symbol"))
    )


COLUMNS = "token_key string, source string, link string, title string, snippet string, timestamp bigint, item bigint"


def rows(spark, source, data, **constants):
    df = spark.createDataFrame(data, COLUMNS).withColumn(
        "arrival", arrival(source, F.lit(0), F.lit(0), F.col("item"))
    )
    for name, value in constants.items():
        df = df.withColumn(name, F.lit(value))
    return df


def run(spark, previous, search=(), default=(), own=(), now=NOW, strategy="grams"):
    return refresh(
        tokens=registry(spark),
        previous=previous_articles(previous),
        search=as_articles(rows(spark, SEARCH, list(search)), "token_key"),
        default_feed=as_articles(rows(spark, DEFAULT_FEED, list(default))),
        token_feed=as_articles(
            rows(spark, TOKEN_FEED, list(own), relevance=10.0, pinned=True), "token_key"
        ),
        as_of=as_of(now),
        strategy=strategy,
    )


def titles(state):
    return {(r.token_key, r.title): r for r in state.collect()}


def empty(spark):
    return spark.createDataFrame([], SNAPSHOT)


def test_shared_articles_reach_the_tokens_they_score_for(spark):
    default = [(None, "s", "/1", "lido lido news", "lido", NOW, 0), (None, "s", "/2", "other", "other other", NOW, 1),
               (None, "s", "/3", "weather", "rain", NOW, 2)]
    for strategy in ("inline", "grams"):
        state = titles(run(spark, empty(spark), default=default, strategy=strategy))
        assert set(state) == {("ldo", "lido lido news"), ("oth", "other")}


def test_newer_shared_copy_replaces_an_assigned_row_and_may_drop_it(spark):
    """The shared row wins by time, then fails the threshold: the key is gone."""
    search = [("ldo", "s", "/1", "plain", "lido lido lido", NOW - 100, 0)]
    kept = titles(run(spark, empty(spark), search=search))
    assert set(kept) == {("ldo", "plain")}
    newer = [(None, "s", "/1", "plain", "nothing", NOW - 50, 0)]
    assert titles(run(spark, empty(spark), search=search, default=newer)) == {}
    older = [(None, "s", "/1", "plain", "nothing", NOW - 100, 0)]
    assert set(titles(run(spark, empty(spark), search=search, default=older))) == {("ldo", "plain")}


def test_own_feed_rows_are_pinned_and_stay_so(spark, tmp_path):
    root = str(tmp_path / "snapshots")
    own = [("ldo", "blog", "/p", "no phrase at all", "", NOW - 5 * DAY, 0)]
    first = run(spark, read_snapshot(spark, root), own=own)
    write_snapshot(first, root, NOW)
    saved = read_snapshot(spark, root)
    assert [(r.title, r.relevance, r.pinned) for r in saved.collect()] == [("no phrase at all", 10.0, True)]
    again = run(spark, saved, own=own, now=NOW + DAY)
    assert titles(again)["ldo", "no phrase at all"].relevance == 10.0
    assert set(titles(run(spark, saved, now=NOW + DAY))) == {("ldo", "no phrase at all")}


def test_previous_rows_are_scored_again(spark, tmp_path):
    root = str(tmp_path / "snapshots")
    search = [("ldo", "s", "/1", "lido", "lido", NOW, 0), ("ldo", "s", "/2", "x", "lido lido lido", NOW, 1)]
    write_snapshot(run(spark, empty(spark), search=search), root, NOW)
    state = titles(run(spark, read_snapshot(spark, root), now=NOW + DAY))
    assert set(state) == {("ldo", "lido"), ("ldo", "x")}


def test_search_rows_before_the_window_are_left_out(spark, tmp_path):
    root = str(tmp_path / "snapshots")
    first = [("ldo", "s", "/1", "lido", "lido", NOW - 3 * DAY, 0)]
    write_snapshot(run(spark, empty(spark), search=first), root, NOW)
    later = [("ldo", "s", f"/n{d}", f"lido {d}", "lido", NOW - d * DAY, d) for d in range(1, 6)]
    state = titles(run(spark, read_snapshot(spark, root), search=later, now=NOW + DAY))
    assert set(state) == {("ldo", "lido"), *(("ldo", f"lido {d}") for d in (1, 2, 3))}


def test_first_run_looks_back_the_tokens_years(spark):
    search = [("oth", "s", "/1", "other", "other other", NOW - 366 * DAY, 0),
              ("oth", "s", "/2", "other 2", "other other", NOW - 365 * DAY, 1),
              ("ldo", "s", "/3", "lido", "lido lido", NOW - 700 * DAY, 2)]
    assert set(titles(run(spark, empty(spark), search=search))) == {("oth", "other 2"), ("ldo", "lido")}


def test_positions_follow_the_order_of_the_list(spark, tmp_path):
    root = str(tmp_path / "snapshots")
    own = [("ldo", "s", f"/{i}", f"t{i}", "", NOW - (i % 4), i) for i in range(40)]
    write_snapshot(run(spark, empty(spark), own=own), root, NOW)
    saved = read_snapshot(spark, root).orderBy("position").collect()
    expected = sorted(range(40), key=lambda i: (i % 4, i))
    assert [r.title for r in saved] == [f"t{i}" for i in expected]


def test_plan_has_no_pairing_without_keys_and_no_python_in_scoring(spark):
    default = [(None, "s", "/1", "lido lido news", "lido", NOW, 0)]
    plan = run(spark, empty(spark), default=default)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
