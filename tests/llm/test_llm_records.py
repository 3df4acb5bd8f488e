"""WARC bundles, URL filtering, mixing and chat transcripts."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from newsweave.llm import chat, mixing, url_filter, warc

# WARC

PAGES = "page_id long, url string, html string, digest string"


def pages(spark):
    rows = [(i, f"http://a.example/{i}", f"<p>page {i % 7}</p>" * 50, "d") for i in range(40)]
    rows += [(100, None, None, "d"), (101, "http://b\r\nX: y", "", "d"), (102, "http://é.example", "é" * 200_000, "d")]
    rows += [(3, rows[3][1], rows[3][2], "d"), (None, "u", rows[4][2], "d"), (None, "u", "only", "d")]
    return rows, spark.createDataFrame(rows, PAGES)


def test_records_come_back_whole(spark, monkeypatch, tmp_path):
    rows, df = pages(spark)
    index = warc.archive(df.coalesce(2), str(tmp_path))
    got = warc.read_bundles(index).toPandas()
    first = {}
    for page_id, _, html, _ in rows:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    want = []
    for page_id, _, html, _ in rows:
        data, least = (html or "").encode(), first.get(html or "")
        revisit = page_id != least
        want.append((page_id, len(data), warc.base32_sha1(data), "revisit" if revisit else "response", least if revisit else None))
    number = lambda x: None if pd.isna(x) else int(x)
    ours = [(number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in got.itertuples()]
    assert sorted(ours, key=str) == sorted(want, key=str)
    texts = {number(r.page_id): r.payload for r in got.itertuples() if r.record_type == "response"}
    assert texts[102] == ("é" * 200_000).encode() and texts[100] == b""
    some = warc.lookup(index, spark.createDataFrame([(5,), (102,), (999,)], "page_id long")).toPandas()
    assert sorted(some.page_id) == [5, 102]
    names = {r.bundle for r in index.select("bundle").distinct().collect()}
    for name in names:
        with pyarrow.fs.LocalFileSystem().open_input_file(name) as source:
            frames = warc.seek_table(source)
        most = index.where(F.col("bundle") == name).agg(F.max("frame")).first()[0]
        assert len(frames) == most + 1


def test_no_pages(spark):
    assert warc.read_bundles(warc.archive(spark.createDataFrame([], PAGES))).count() == 0


# URLs


def test_hosts_paths_and_listed_rules(spark):
    urls = {
        "http://EXAMPLE.com/en/1?x#y": ("example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://a.www.example.com/en/x": ("a.www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.net/es/?q": ("x.net", "/es/", "net/es/", "block"),
        "http://x.net/fr": ("x.net", "/fr", None, "allow"),
        "http://com?/": ("com", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, "clash") for i, u in enumerate(urls)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, verdict string"), none)
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert [found[i] for i in range(len(urls))] == list(urls.values())


def test_mined_rules_against_counting(spark):
    rng = random.Random(8)
    urls = [f"http://{rng.choice(['ads', 'blog', 'shop'])}.site.org/{rng.choice(['x', 'y', 'z'])}/{i}" for i in range(600)]
    bad = ["ads" in u and "/x/" in u or rng.random() < 0.02 for u in urls]
    pages_ = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if b else 1, None) for i, b in enumerate(bad)] + [(None, 0, 0), (5000, None, None)], "doc_id long, quality int, toxic int")
    rules = url_filter.mined_rules(pages_, labels)
    sets = [url_filter.url_tokens(u) for u in urls]
    for tokens, verdict, confidence, support in rules:
        has = [b == (verdict == "block") for s, b in zip(sets, bad, strict=True) if s >= set(tokens)]
        assert math.isclose(confidence, sum(has) / len(has)) and math.isclose(support, sum(has) / len(urls))
        assert confidence >= url_filter.LEAST_CONFIDENCE and support >= url_filter.LEAST_SUPPORT
    assert any(set(r[0]) == {"host:ads", "path:x"} and r[1] == "block" for r in rules)
    index = url_filter.RuleIndex(rules)
    for s in sets:
        fits = [i for i, r in enumerate(rules) if s >= set(r[0])]
        assert index.first(s) == min(fits, default=None)
    verdicts = url_filter.judged(pages_, labels).toPandas()
    planted = verdicts.url.str.contains("//ads.*/x/")
    assert (verdicts[planted].verdict == "block").all() and (verdicts[~planted].verdict == "allow").all()


@pytest.mark.parametrize("most", [3, 2000])
def test_no_rule_is_cut(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_RULES", most)
    # 20 bad hosts, each with its own path, and one combination of six names that is bad only as a whole
    urls = [f"http://bad{h}.org/p{h}/" for h in range(20) for _ in range(30)]
    urls += [f"http://good{h}.org/{h % 7}/" for h in range(1000)]
    combos = ["&".join(f"n{i}={c}" for i in range(6) if c >> i & 1) for c in range(64) for _ in range(12)]
    urls += [f"http://good.org/?{q}" for q in combos]
    bad = ["bad" in u or u.count("n") == 6 for u in urls]
    pages_ = spark.createDataFrame([*enumerate(urls), (None, None)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, None) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    got = url_filter.judged(pages_, labels).toPandas()
    assert len(got) == len(urls) + 1
    verdict = {r.page_id: (r.verdict, r.mined_rule) for r in got.itertuples() if r.url is not None}
    assert [verdict[i][0] == "block" for i in range(len(urls))] == bad
    index = url_filter.RuleIndex(url_filter.mined_rules(pages_, labels))
    for u in sorted(set(urls)):
        i = index.first(url_filter.url_tokens(u))
        assert verdict[urls.index(u)][1] == (None if i is None else " & ".join(index.rules[i][0]))


# Mixing


def targets_by_rounds(sizes):
    """Sources by order -> target, sharing out the excess until there is none."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= above


def test_mix_reaches_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN_ROWS", 7)
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randint(0, 30)), rng.choice(["b", "a", "é", "a", "a", None]), 1) for i in range(300)]
    rows += [(900, None, "a", 1), (901, "", "z", 1), (None, "one two", "a", 1), (7, *rows[7][1:]), (902, "x" * 100_000 + " y", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 300, 3)] + [(3, 0, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.mixed(docs, labels).select("doc.doc_id", "size", "source_size", "target", "taken").toPandas()
    again = mixing.mixed(docs.repartition(5), labels).select("doc.doc_id", "taken").toPandas()
    assert sorted(zip(got.doc_id.fillna(-1), got.taken, strict=True)) == sorted(zip(again.doc_id.fillna(-1), again.taken, strict=True))
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = targets_by_rounds(sizes)
    assert np.allclose(sorted(got.target.unique()), sorted(set(want.values())))
    assert (got.taken <= 2 * got["size"]).all() and len(got) == len(rows)
    for (target, _), part in got.groupby(["target", "source_size"]):
        assert part.taken.sum() == math.floor(target)
    took = mixing.mixture(docs, labels)
    assert took.columns == ["doc_id", "text", "source", "taken"] and took.where("taken <= 0").count() == 0
    assert took.agg(F.sum("taken")).first()[0] == got.taken.sum()


def test_better_documents_come_first(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s") for i in range(2000)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(2000)], "doc_id long, quality int, toxic int")
    # One source: half of its words are taken twice.
    got = mixing.mixed(docs, labels).select("doc.doc_id", "taken").toPandas()
    assert got[got.doc_id % 2 == 1].taken.sum() > 1.1 * got[got.doc_id % 2 == 0].taken.sum()


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mixed(docs, labels).count() == 0
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], docs.schema)
    assert [r.taken for r in mixing.mixed(empty, labels).collect()] == [0, 0]


# Chat

TALK = "conv_id long, turn long, role string, text string, part int"


def talks(n=60, seed=10):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        roles = (["system"] if rng.random() < 0.3 else []) + ["user", "assistant"] * rng.randint(1, 4)
        for turn, role in enumerate(roles):
            size = {"system": 6, "user": 12, "assistant": 60}[role]
            lines = [" ".join("word" for _ in range(rng.randint(2, size))) for _ in range(rng.randint(1, 3))]
            rows.append((conv, turn, role, "\n".join(lines) + ("?" if role == "user" else "."), 0))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return chat.fit(chat.as_transcripts(spark.createDataFrame(talks(), TALK)))


def test_viterbi_against_all_paths(model):
    rng = np.random.default_rng(11)
    for _ in range(20):
        seen = np.stack([rng.integers(0, n, 4) for n in chat.SIZES], axis=1)
        shown = model.emissions(seen)

        def score(path, shown=shown):
            out = model.first[path[0]] + shown[0, path[0]]
            return out + sum(model.moves[a, b] + shown[i + 1, b] for i, (a, b) in enumerate(itertools.pairwise(path)))

        best = max(score(p) for p in itertools.product(range(chat.STATES), repeat=4))
        assert math.isclose(score(model.path(seen, None)), best)


@pytest.mark.parametrize("segment", [1, 2, 3])
def test_segments_give_the_path_of_the_whole(spark, model, monkeypatch, segment):
    transcripts = chat.as_transcripts(spark.createDataFrame(talks(seed=12), TALK))
    whole = sorted(map(str, chat.parse(transcripts, model).collect()))
    monkeypatch.setattr(chat, "SEGMENT", segment)
    assert sorted(map(str, chat.parse(transcripts, model).collect())) == whole


def test_roles_of_other_conversations(spark, model):
    rows = talks(seed=13)
    got = chat.parse(chat.as_transcripts(spark.createDataFrame(rows, TALK)), model).where("part = 0").toPandas()
    true = {(c, t): role for c, t, role, _, _ in rows}
    right = [true[(r.conv_id, r.turn)] == r.role for r in got.itertuples()]
    assert len(right) == len(rows) and np.mean(right) > 0.9


def test_rendering_and_odd_blocks(spark, model):
    rows = [
        (1, 0, "", "User: hi there?\nmore\nAssistant: yes it is so", 0), (2, 0, "", None, 0), (2, 1, "", "", 0), (None, 0, "", "Q: what?", 0),
        (None, 0, "", "Q: what?", 0), (3, None, "", "Human: a?", 0), (4, 0, "", "Bot: " + "long " * 50_000, 0), (4, 0, "", "Bot: b", 0),
    ]
    got = chat.parse(spark.createDataFrame(rows, TALK), model).toPandas()
    one = got[got.conv_id == 1].sort_values("part")
    assert one.rendered.tolist() == [
        "<|im_start|>user\nhi there?\nmore<|im_end|>", "<|im_start|>assistant\nyes it is so<|im_end|>",
    ]
    assert sorted(got.conv_id.fillna(-1).unique()) == [-1, 1, 2, 3, 4] and (got.conv_id.isna()).sum() == 1
    assert chat.parse(spark.createDataFrame([], TALK), model).count() == 0
    assert chat.fit(spark.createDataFrame([], TALK)).path(np.zeros((2, 3), int), None)


def test_no_segment_is_larger_than_its_bound(spark, model):
    """Ten thousand rows of one turn, and of none, are cut like others."""
    rows = [(1, t, "user", f"line {i}", 0) for t in (7, None) for i in range(5_000)] + [(2, 0, "user", "user: hi", 0)]
    blocks = chat._blocks(chat.as_transcripts(spark.createDataFrame(rows, TALK)))
    assert blocks.groupBy("conv", "segment").count().agg({"count": "max"}).first()[0] <= chat.SEGMENT
    assert chat.parse(chat.as_transcripts(spark.createDataFrame(rows, TALK)), model).select("conv_id", "turn", "text").count() >= len(rows)


def test_ids_and_turns_of_other_types(spark, model):
    rows = spark.createDataFrame([(1, 0, "user", "user: hi", 0), (1, 1, "assistant", "assistant: hello", 0)], TALK)
    cast = rows.selectExpr("cast(conv_id as smallint) conv_id", "cast(turn as decimal(9,1)) turn", "role", "text")
    got = chat.parse(cast, model)
    assert dict(got.dtypes)["turn"] == "decimal(9,1)" and dict(got.dtypes)["conv_id"] == "smallint"
    assert [(int(r.turn), r.role, r.text) for r in got.orderBy("turn").collect()] == [(0, "user", "hi"), (1, "assistant", "hello")]
