import json

import pytest
from pyspark.errors import StreamingQueryException

from newsweave.plans import runs
from newsweave.plans.runs import run_publication, run_refresh, run_registry
from newsweave.sources import commits, landed
from newsweave.operators.tokens import prepare_tokens
from newsweave.sources.registry_files import load_settings, read_registry
from newsweave.sources.snapshots import read_published, read_snapshot
from newsweave.streaming.refresh import refresh_stream
from test_sources import NOW, RSS, put

DAY = 86400
SETTINGS = {
    "default_relevance_threshold": 6.5,
    "default_rss_feeds": ["https://a/rss"],
    "tokens": [
        {"name": "Zork", "symbol": "ZRK", "address": {"c": "0x1"}, "additional_phrases": ["text"],
         "rss_feeds": [{"tag": "dao", "url": "https://own/rss"}]},
        {"name": "Quiet", "symbol": "QT", "address": {"c": "0x2"}},
    ],
}


def test_two_refreshes_from_files(spark, tmp_path):
    put(tmp_path / "config.json", json.dumps(SETTINGS))
    settings, tokens = load_settings(spark, str(tmp_path / "config.json"))
    for name in ("a", "own"):
        put(tmp_path / "feeds" / f"url=https%3A%2F%2F{name}%2Frss" / "fetched=1" / "d.xml", RSS.replace("Feed &amp; Co", name))
    query = landed.planned_queries(prepare_tokens(tokens, settings)).filter("query like 'Zork%'").first()
    result = {"title": "Zork Zork", "link": "/s", "snippet": "Zork", "source": "s", "date": "3 hours ago"}
    put(tmp_path / "search" / f"query_id={query.query_id}" / "page=1" / f"fetched={NOW - 60}" / "r.json", json.dumps({"news_results": [result]}))
    paths = dict(
        search_path=str(tmp_path / "search"), feeds_path=str(tmp_path / "feeds"),
        snapshots=str(tmp_path / "snapshots"), published=str(tmp_path / "out"),
    )
    report, new = run_refresh(spark, settings, tokens, as_of=NOW, **paths)
    # both entries of the own feed, the search row, and no other row scores 6.5
    assert [(r.kept, r.previous) for r in report.collect()] == [(3, 0)]
    assert {r.title for r in new.collect()} == {"A & B", "No date", "Zork Zork"}
    first = sorted(map(str, read_snapshot(spark, paths["snapshots"]).collect()))
    report, new = run_refresh(spark, settings, tokens, as_of=NOW + DAY, **paths)
    # nothing was fetched since, so nothing moves
    assert [(r.kept, r.previous) for r in report.collect()] == [(3, 3)] and new.count() == 0
    assert sorted(map(str, read_snapshot(spark, paths["snapshots"]).collect())) == first
    out = tmp_path / "out" / f"snapshot={NOW + DAY}"
    lines = [json.loads(x) for f in sorted(out.rglob("part-*")) for x in f.read_text().splitlines() if x]
    # the undated entry is as old as its fetch
    assert [x["title"] for x in lines] == ["Zork Zork", "A & B", "No date"]
    assert "relevance" not in lines[0]
    assert read_published(spark, paths["published"]).count() == 3
    # the token without articles has an empty list of its own
    assert len([p for p in out.iterdir() if p.name.startswith("token_key=")]) == 2


def test_a_stream_ends_in_the_state_of_runs(spark, tmp_path):
    """Batches of landings, one after the other, against a run after each."""
    put(tmp_path / "config.json", json.dumps(SETTINGS))
    settings, tokens = load_settings(spark, str(tmp_path / "config.json"))
    query = landed.planned_queries(prepare_tokens(tokens, settings)).filter("query like 'Zork%'").first()
    paths = dict(search_path=str(tmp_path / "search"), feeds_path=str(tmp_path / "feeds"))
    fields = ["token_key", "title", "link", "timestamp", "relevance", "pinned"]
    for step in range(2):
        fetched = NOW + step * DAY - 60
        for name in ("a", "own"):
            text = RSS.replace("Feed &amp; Co", name).replace("No date", f"No date {step} text Zork")
            put(tmp_path / "feeds" / f"url=https%3A%2F%2F{name}%2Frss" / f"fetched={fetched}" / "d.xml", text)
        result = {"title": f"Zork Zork {step}", "link": "/s", "snippet": "Zork", "source": "s", "date": "3 hours ago"}
        put(tmp_path / "search" / f"query_id={query.query_id}" / "page=1" / f"fetched={fetched}" / "r.json", json.dumps({"news_results": [result]}))
        outs = {}
        for kind in ("run", "stream"):
            root = {k: str(tmp_path / kind / k) for k in ("snapshots", "published")}
            if kind == "run":
                run_refresh(spark, settings, tokens, as_of=NOW + step * DAY, **paths, **root)
            else:
                checkpoint = str(tmp_path / "checkpoint")
                refresh_stream(spark, settings, tokens, as_of=NOW + step * DAY, checkpoint=checkpoint, **paths, **root).awaitTermination()
            state = read_snapshot(spark, root["snapshots"])
            outs[kind] = sorted(map(str, state.select(fields).collect())), read_published(spark, root["published"]).count()
        assert outs["run"] == outs["stream"] and outs["run"][1] >= 4 + 2 * step


def _land(tmp_path, query, days):
    """Feeds and a search response of each day, as they were fetched."""
    for day in days:
        fetched = NOW + day * DAY
        text = RSS.replace("Feed &amp; Co", "own").replace("No date", f"No date {day}")
        put(tmp_path / "feeds" / "url=https%3A%2F%2Fown%2Frss" / f"fetched={fetched}" / "d.xml", text)
        result = {"title": f"Zork Zork {day}", "link": "/s", "snippet": "Zork", "source": "s", "date": "3 hours ago"}
        put(tmp_path / "search" / f"query_id={query}" / "page=1" / f"fetched={fetched}" / "r.json", json.dumps({"news_results": [result]}))


def _setting(spark, tmp_path):
    put(tmp_path / "config.json", json.dumps(SETTINGS))
    settings, tokens = load_settings(spark, str(tmp_path / "config.json"))
    query = landed.planned_queries(prepare_tokens(tokens, settings)).filter("query like 'Zork%'").first().query_id
    paths = {k: str(tmp_path / k.split("_")[0]) for k in ("search_path", "feeds_path", "snapshots", "published")}
    return settings, tokens, query, paths


def _titles(spark, paths):
    return sorted(r.title for r in read_snapshot(spark, paths["snapshots"]).collect())


def test_one_stream_follows_the_days_of_its_landings(spark, tmp_path):
    settings, tokens, query, paths = _setting(spark, tmp_path)
    days = range(3)
    _land(tmp_path, query, days)
    stream = refresh_stream(spark, settings, tokens, checkpoint=str(tmp_path / "check"), max_files_per_trigger=1, **paths)
    stream.awaitTermination()
    expected = sorted(["A & B", *(f"No date {d}" for d in days), *(f"Zork Zork {d}" for d in days)])
    assert _titles(spark, paths) == expected
    done = commits.commits(spark, paths["snapshots"])
    assert len(done) >= 3 and done[-1].time == NOW + 2 * DAY and len({c.batch for c in done}) == len(done)
    # a run over the same landings finds nothing that is new
    report, new = run_refresh(spark, settings, tokens, as_of=NOW + 5 * DAY, **paths)
    assert new.count() == 0 and _titles(spark, paths) == expected


def test_a_late_landing_is_read_in_its_own_window(spark, tmp_path):
    settings, tokens, query, paths = _setting(spark, tmp_path)
    _land(tmp_path, query, [0])
    run_refresh(spark, settings, tokens, as_of=NOW + 60, **paths)
    _land(tmp_path, query, [4])
    run_refresh(spark, settings, tokens, as_of=NOW + 4 * DAY + 60, **paths)
    _land(tmp_path, query, [2])  # dated before the newest article, fetched before the last run
    run_refresh(spark, settings, tokens, as_of=NOW + 5 * DAY, **paths)
    assert {f"Zork Zork {d}" for d in (0, 2, 4)} <= set(_titles(spark, paths))


@pytest.mark.parametrize("step, after, kind", [
    ("write_state", True, "run"), ("write_published", True, "stream"), ("commit", False, "run"), ("commit", True, "stream"),
])
def test_a_crash_at_any_write_loses_nothing(spark, tmp_path, monkeypatch, step, after, kind):
    settings, tokens, query, paths = _setting(spark, tmp_path)
    _land(tmp_path, query, [0])

    def refreshed(as_of):
        if kind == "run":
            run_refresh(spark, settings, tokens, as_of=as_of, **paths)
        else:
            refresh_stream(spark, settings, tokens, checkpoint=str(tmp_path / "check"), **paths).awaitTermination()

    refreshed(NOW)
    _land(tmp_path, query, [1])
    whole = getattr(runs, step)

    def dies(*args, **kwargs):
        if after:
            whole(*args, **kwargs)
        raise OSError("the driver is gone")

    monkeypatch.setattr(runs, step, dies)
    with pytest.raises((OSError, StreamingQueryException)):
        refreshed(NOW + DAY)
    monkeypatch.setattr(runs, step, whole)
    refreshed(NOW + DAY)
    assert _titles(spark, paths) == ["A & B", "No date 0", "No date 1", "Zork Zork 0", "Zork Zork 1"]
    assert read_published(spark, paths["published"]).count() == 5
    done = commits.commits(spark, paths["snapshots"])
    assert len(done) == 2


def test_a_registry_run_can_be_started_again(spark, tmp_path, monkeypatch):
    a = "0x" + "a" * 40
    put(tmp_path / "platforms.json", json.dumps({"data": {"platformToChainIdMap": {"eth": 1}}}))
    put(tmp_path / "coins" / "network=eth" / "a.json", json.dumps({"data": {"tokens": [{"address": a, "symbol": "x"}]}}))
    put(tmp_path / "metadata.json", json.dumps({"chain_id": 1, "address": a, "name": "N", "symbol": "S"}))
    paths = dict(networks_path=str(tmp_path / "platforms.json"), candidates_path=str(tmp_path / "coins"),
                 metadata_path=str(tmp_path / "metadata.json"), registry_root=str(tmp_path / "registry"))
    for step in ("write_part", "write_registry"):
        whole = getattr(runs, step)

        def dies(*args, **kwargs):
            if step == "write_part":
                whole(*args, **kwargs)
            raise OSError("the driver is gone")

        monkeypatch.setattr(runs, step, dies)
        with pytest.raises(OSError):
            run_registry(spark, as_of=1, **paths)
        monkeypatch.setattr(runs, step, whole)
    run_registry(spark, as_of=1, **paths)
    assert read_registry(spark, str(tmp_path / "registry")).count() == 1


def test_only_new_landings_are_read(spark, tmp_path):
    paths = [tmp_path / "in" / "url=a%2F" / f"fetched={f}" / "d.xml" for f in (50, 5)]
    put(paths[0], RSS)
    root = str(tmp_path / "state")
    first = commits.new_landings(spark, str(tmp_path / "in"), root).collect()
    assert [r.path.endswith("fetched=50/d.xml") for r in first] == [True]
    attempt = commits.new_attempt()
    commits.write_part(spark.createDataFrame([(first[0].landing,)], "landing string"), root, attempt, commits.LANDINGS)
    assert commits.new_landings(spark, str(tmp_path / "in"), root).count() == 1  # not committed yet
    commits.commit(spark, root, attempt, 60)
    put(paths[1], RSS)  # fetched long before, landed late
    later = commits.new_landings(spark, str(tmp_path / "in"), root).collect()
    rows = landed.read_feed_entries(spark, str(tmp_path / "in"), files=[r.path for r in later]).collect()
    assert {r.fetched for r in rows} == {5} and {r.landing for r in rows} == {later[0].landing}


def test_registry_run(spark, tmp_path):
    a = "0x" + "a" * 40
    put(tmp_path / "platforms.json", json.dumps({"data": {"platformToChainIdMap": {"eth": 1}}}))
    put(tmp_path / "coins" / "network=eth" / "a.json", json.dumps({"data": {"tokens": [{"address": a, "symbol": "x"}, {"address": "0x12", "symbol": "lost"}]}}))
    put(tmp_path / "metadata.json", json.dumps({"chain_id": 1, "address": a, "name": "N", "symbol": "S"}))
    paths = dict(networks_path=str(tmp_path / "platforms.json"), candidates_path=str(tmp_path / "coins"),
                 metadata_path=str(tmp_path / "metadata.json"), registry_root=str(tmp_path / "registry"))
    for as_of, fresh in ((1, 1), (2, 0)):
        report, failed = run_registry(spark, as_of=as_of, **paths)
        counts = {r.network: (r.total_tokens, r.new_tokens) for r in report.collect()}
        assert [r.symbol for r in failed.collect()] == ["lost"]
        assert counts == {"eth": (1, fresh), None: (1, fresh)}
        assert read_registry(spark, str(tmp_path / "registry")).count() == 1


def test_publication_run(spark, tmp_path):
    pages = [(1, "u", "<p>2024-12-04</p>"), (2, "v", "<p>none</p>")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages"))
    run_publication(spark, str(tmp_path / "pages"), str(tmp_path / "dates"), NOW)
    found = {r.page_id: (r.epoch, r.date_source) for r in spark.read.parquet(str(tmp_path / "dates")).collect()}
    assert found == {1: (1733270400, "text"), 2: (None, None)}
