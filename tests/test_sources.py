import json

import pytest
from pyspark.sql import functions as F

from newsweave.operators.tokens import prepare_tokens
from newsweave.plans.refresh import default_feed_articles, token_feed_articles
from newsweave.schemas import TOKEN
from newsweave.settings import Settings
from newsweave.sources import commits, landed
from newsweave.sources.registry_files import (
    default_feed_urls,
    load_settings,
    read_listed_tokens,
    read_registry,
    write_registry,
)
from newsweave.operators.articles import new_articles, refresh_report
from newsweave.schemas import SNAPSHOT
from newsweave.sources.commits import commits as commits_of
from newsweave.sources.snapshots import (
    append_items,
    new_in_state,
    newest_finished,
    read_snapshot,
    read_state,
    read_totals,
    snapshot_time,
    totals_report,
    write_snapshot,
)

NOW = 1735689600


def as_of():
    return F.lit(NOW).cast("bigint")


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


SETTINGS = """
default_relevance_threshold: 7.5
output_dir: out
default_rss_feeds: [https://a/rss, https://b/rss]
tokens:
  - name: Liquid
    symbol: stETH
    address: {ethereum: "0xAE"}
    mandatory_phrases: [lido]
    rss_feeds:
      - {tag: dao, url: "https://c/rss"}
"""


def test_settings_from_yaml(spark, tmp_path):
    put(tmp_path / "config.yaml", SETTINGS)
    settings, tokens = load_settings(spark, str(tmp_path / "config.yaml"))
    assert settings == Settings(
        default_relevance_threshold=7.5,
        output_dir="out",
        default_rss_feeds=("https://a/rss", "https://b/rss"),
    )
    assert tokens.schema == TOKEN
    row = prepare_tokens(tokens, settings).first()
    assert (row.threshold, row.lookback_years, row.keywords) == (7.5, 2, ["liquid", "steth", "lido"])
    assert [tuple(f) for f in row.rss_feeds] == [("dao", "https://c/rss")]
    assert [r.url for r in default_feed_urls(spark, settings).orderBy("feed").collect()] == ["https://a/rss", "https://b/rss"]


def test_tokens_of_many_settings_files(spark, tmp_path):
    token = {"name": "A", "symbol": "a", "relevance_threshold": None}
    for name, body in {
        "one": json.dumps({"default_relevance_threshold": 7.5, "tokens": [token, {**token, "symbol": "b", "relevance_threshold": 9.0}]}),
        "two": json.dumps({"tokens": [{**token, "symbol": "c"}]}),
        "odd": json.dumps({"tokens": "none"}), "broken": "{broken", "empty": "",
    }.items():
        put(tmp_path / f"{name}.json", body)
    listed = read_listed_tokens(spark, str(tmp_path))
    assert listed.schema == TOKEN
    assert {r.symbol: r.relevance_threshold for r in listed.collect()} == {"a": 7.5, "b": 9.0, "c": None}


def test_bad_settings_give_defaults(spark, tmp_path):
    for i, text in enumerate(["- a\n- b", "{broken: [", "", '{"tokens": "none"}']):
        put(tmp_path / f"{i}.yaml", text)
        settings, tokens = load_settings(spark, str(tmp_path / f"{i}.yaml"))
        assert settings == Settings() and tokens.count() == 0
    settings, tokens = load_settings(spark, str(tmp_path / "missing.yaml"))
    assert settings == Settings() and tokens.count() == 0


def test_registry_table(spark, tmp_path):
    root = str(tmp_path / "registry")
    assert read_registry(spark, root).count() == 0
    rows = [("N", "S", {"c": "0x1"}, 2, None, [], ["defi"], None)]
    write_registry(spark.createDataFrame(rows, TOKEN), root, 1)
    write_registry(read_registry(spark, root).unionByName(spark.createDataFrame(rows, TOKEN)), root, 2)
    again = read_registry(spark, root)
    assert again.count() == 2 and again.first().address == {"c": "0x1"}


def test_search_responses(spark, tmp_path):
    results = [
        {"title": "T1", "link": "/1", "snippet": "a &amp; b", "source": "s", "date": "2 hours ago"},
        {"title": None, "link": "/2", "source": "s", "date": "Dec 4, 2024"},
        {"title": "T3", "link": "/3", "snippet": "x", "source": "s"},
    ]
    root = tmp_path / "search"
    put(root / "query_id=q1" / "page=1" / "a.json", json.dumps({"news_results": results}, indent=1))
    put(root / "query_id=q1" / "page=2" / "a.json", json.dumps({"error": "limit", "news_results": results}))
    put(root / "query_id=q2" / "page=1" / "a.json", json.dumps({}))
    articles = landed.search_articles(landed.read_search(spark, str(root), lines=False), as_of())
    found = {r.link: r for r in articles.collect()}
    assert set(found) == {"/1", "/2", "/3"}
    assert found["/1"].snippet == "a & b" and found["/1"].timestamp == NOW - 7200
    assert (found["/2"].title, found["/2"].snippet, found["/2"].timestamp) == ("", "", 1733270400)
    assert (found["/3"].timestamp, found["/3"].date_source) == (NOW, "fallback")
    assert {(r.query_id, r.page) for r in found.values()} == {("q1", 1)}


def test_search_rows_belong_to_every_token_that_asked(spark, tmp_path):
    rows = [(n, "S", {"c": n}, None, None, [], ["x"], None) for n in ("A", "B")]
    tokens = prepare_tokens(spark.createDataFrame(rows, TOKEN))
    queries = landed.planned_queries(tokens).orderBy("token_key", "query_order").collect()
    assert sorted(q.query for q in queries) == ["A S ", "A S  x", "B S ", "B S  x"]
    for q in queries:
        text = json.dumps({"news_results": [{"title": q.query, "link": "/", "source": "s"}]})
        put(tmp_path / f"query_id={q.query_id}" / "page=1" / "a.json", text)
    articles = landed.search_articles(landed.read_search(spark, str(tmp_path)), as_of())
    found = landed.token_search_articles(articles, tokens)
    assert {(r.token_key, r.title) for r in found.collect()} == {(q.token_key, q.query) for q in queries}


def test_search_rows_need_not_say_when_they_were_fetched(spark):
    tokens = prepare_tokens(spark.createDataFrame([("A", "S", {"c": "A"}, None, None, [], ["x"], None)], TOKEN))
    zero = F.lit(0).cast("bigint")
    rows = landed.planned_queries(tokens).select("query_id", F.col("query").alias("title"), zero.alias("page"), zero.alias("item"))
    found = landed.token_search_articles(rows, tokens)
    assert dict(found.dtypes)["fetched"] == "bigint"
    assert {(r.title, r.fetched, r.arrival.list) for r in found.collect()} == {("A S ", None, 1), ("A S  x", None, 2)}


def test_search_rows_are_joined_without_a_broadcast_of_the_plan(spark):
    """Spark takes the 2^n queries of a token for as small as the token."""
    phrases = [f"p{i}" for i in range(13)]
    rows = [(n, "S", {"c": n}, None, None, [], p, None) for n, p in (("A", phrases), ("B", []))]
    tokens = prepare_tokens(spark.createDataFrame(rows, TOKEN))
    zero = F.lit(0).cast("bigint")
    planned = landed.planned_queries(tokens)
    asked = planned.select("query_id", F.col("query").alias("title"), zero.alias("page"), zero.alias("item"))
    found = landed.token_search_articles(asked, tokens).select("token_key", "title", F.col("arrival.list").alias("query_order"))
    got = sorted(map(tuple, found.collect()))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert got == sorted(map(tuple, planned.select("token_key", "query", "query_order").collect())) and len(got) == 2**13 + 1


RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>Feed &amp; Co</title>
<item><title>A &amp; B</title><link>https://x/1</link><description><![CDATA[<p>Some <b>text</b></p>]]></description>
<pubDate>Wed, 04 Dec 2024 10:30:00 +0200</pubDate></item>
<item><title>No date</title><link>https://x/2</link></item></channel></rss>"""
NAMELESS = """<rss><channel><item><title>C</title><pubDate>Wed, 04 Dec 2024 10:30:00 GMT</pubDate></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Atom</title><entry><title>E</title>
<link href="https://x/self" rel="self"/><link href="https://x/3"/><summary>s</summary>
<updated>2024-12-04T10:30:00Z</updated></entry></feed>"""


def test_feeds(spark, tmp_path):
    for name, text in [("a", RSS), ("b", NAMELESS), ("c", ATOM)]:
        put(tmp_path / f"url=https%3A%2F%2F{name}%2Frss" / "fetched=5" / "doc.xml", text)
    entries = landed.read_feed_entries(spark, str(tmp_path))
    articles = landed.feed_articles(entries, as_of())
    found = {r.title: r for r in articles.collect()}
    assert set(found) == {"A & B", "No date", "C", "E"}
    first = found["A & B"]
    assert (first.url, first.source, first.link, first.snippet) == (
        "https://a/rss", "Feed & Co", "https://x/1", "Some text")
    assert (first.timestamp, first.utc_time) == (1733301000, "2024-12-04 08:30:00 UTC")
    assert (found["No date"].timestamp, found["No date"].item, found["No date"].page) == (5, 1, 5)
    assert (found["C"].source, found["C"].link, found["C"].snippet) == ("Unknown", "", "")
    assert (found["E"].link, found["E"].timestamp) == ("https://x/3", 1733308200)

    tokens = prepare_tokens(
        spark.createDataFrame(
            [("N", "S", {}, None, None, [], [], [("dao", "https://c/rss")])], TOKEN
        )
    )
    own = token_feed_articles(articles, tokens).collect()
    assert [(r.title, r.tag, r.relevance, r.pinned) for r in own] == [("E", "dao", 10.0, True)]
    settings = Settings(default_rss_feeds=("https://b/rss", "https://a/rss"))
    shared = default_feed_articles(articles, default_feed_urls(spark, settings)).collect()
    order = sorted(shared, key=lambda r: tuple(r.arrival))
    assert [r.title for r in order] == ["C", "A & B", "No date"]
    assert {r.relevance for r in shared} == {None}


def test_registry_and_chain_files(spark, tmp_path):
    put(tmp_path / "platforms.json", json.dumps({"data": {"platformToChainIdMap": {"eth": 1, "bsc": 56}}}, indent=1))
    networks = landed.read_networks(spark, str(tmp_path / "platforms.json"))
    assert {tuple(r) for r in networks.collect()} == {("eth", 1), ("bsc", 56)}
    coins = {"data": {"tokens": [{"address": "0xA", "symbol": "a"}, {"address": "0xB", "symbol": "b"}]}}
    put(tmp_path / "coins" / "network=eth" / "a.json", json.dumps(coins, indent=1))
    candidates = landed.read_candidates(spark, str(tmp_path / "coins"))
    assert {tuple(r) for r in candidates.collect()} == {("eth", "0xA", "a"), ("eth", "0xB", "b")}
    put(tmp_path / "names.json", json.dumps({"1": "ethereum", "56": "bsc", "x": "odd"}))
    names = landed.read_chain_names(spark, str(tmp_path / "names.json"))
    assert [tuple(r) for r in names.orderBy("pos").collect()] == [(0, 1, "ethereum"), (1, 56, "bsc"), (2, None, "odd")]
    put(tmp_path / "rpcs.json", json.dumps([{"chainId": 1, "rpc": [{"url": "u"}]}, {"chainId": 2}]))
    rpcs = landed.read_chain_rpcs(spark, str(tmp_path / "rpcs.json")).orderBy("pos").collect()
    assert [(r.chainId, r.rpc and [x.url for x in r.rpc]) for r in rpcs] == [(1, ["u"]), (2, None)]


def test_feeds_are_scanned_once(spark, tmp_path):
    put(tmp_path / "url=a" / "fetched=1" / "d.xml", RSS)
    plan = landed.read_feed_entries(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("from_xml") == 1


def test_unfinished_snapshots_are_not_read(spark, tmp_path):
    assert read_snapshot(spark, str(tmp_path / "none")).count() == 0
    root = str(tmp_path / "s")
    for time in (5, 30):
        commits.commit(spark, root, f"attempt=of{time}", time)
    put(tmp_path / "s" / "attempt=half" / "state" / "part.parquet", "half")
    put(tmp_path / "s" / "_commits" / ".draft", "{")
    assert snapshot_time(spark, root) == 30
    assert commits.newest(spark, root).part(spark, "state") == f"{root}/attempt=of30/state"
    for time, batch in ((30, ""), (31, "b-0")):
        if batch:
            commits.commit(spark, root, "attempt=x", time, batch)
        with pytest.raises(FileExistsError):
            commits.commit(spark, root, "attempt=x", time + bool(batch), batch)
    put(tmp_path / "p" / "snapshot=5" / "_SUCCESS", "")
    put(tmp_path / "p" / "snapshot=9" / "part", "half")
    assert newest_finished(spark, str(tmp_path / "p")).endswith("snapshot=5")


def test_append(spark, tmp_path):
    path = str(tmp_path / "items")
    for i in range(2):
        append_items(spark.createDataFrame([(i,)], "i int"), path)
    assert sorted(r.i for r in spark.read.schema("i int").json(path).collect()) == [0, 1]


def _rows(spark, numbers, tokens):
    """State rows of so many tokens, a third of all of the first; every fifth has no link."""
    rows = [(f"k{0 if i % 3 == 0 else i % tokens}", f"t{i}", None if i % 5 == 0 else f"/{i}", "s", i) for i in numbers]
    made = spark.createDataFrame(rows, "token_key string, title string, link string, source string, timestamp long")
    rest = {f.name: F.lit(None).cast(f.dataType) for f in SNAPSHOT if f.name not in made.columns}
    return made.withColumns({**rest, "first_arrival": F.lit(0).cast("long")})


def test_snapshots_are_compared_bucket_by_bucket(spark, tmp_path):
    root = str(tmp_path / "state")
    old, new = _rows(spark, range(0, 600, 2), 400), _rows(spark, range(0, 600, 3), 400)
    write_snapshot(old, root, 1)
    write_snapshot(new, root, 2)
    before, after = commits_of(spark, root)
    found = new_in_state(read_state(spark, after), read_state(spark, before))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")
    assert sorted(r.title for r in found.collect()) == sorted(r.title for r in new_articles(new, old).collect())
    report = totals_report(read_totals(spark, after), read_totals(spark, before))
    assert sorted(map(tuple, report.collect())) == sorted(map(tuple, refresh_report(new, old).collect()))


def test_files_of_a_snapshot_do_not_grow_with_tokens(spark, tmp_path):
    counts = []
    for tokens in (3, 500):
        root = tmp_path / f"state{tokens}"
        write_snapshot(_rows(spark, range(600), tokens), str(root), 1)
        counts.append(len(list(root.glob("attempt=*/state-*/part-*"))))
        assert read_snapshot(spark, str(root)).count() == 600
    assert counts[0] == counts[1] == int(spark.conf.get("spark.sql.shuffle.partitions"))
    # no entries stay in the catalog
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("state_")]
