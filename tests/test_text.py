import html
import random
import re

from pyspark.sql import functions as F

from newsweave.functions.relevance import (
    count_hits,
    normalise_phrases,
    round_score,
    text_relevance,
    unique_ratio,
    words,
)
from newsweave.functions.text import clean_snippet, truncate, utc_text


def expected_cut(text, limit=500):
    if len(text) <= limit:
        return text
    head = text[:limit]
    stop = head.rfind(".")
    return head[: stop + 1] + " ..." if stop > 0 else head + "..."


def test_truncate_follows_the_rule_on_random_texts(column):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab. é漢") for _ in range(rng.randint(480, 530))) for _ in range(200)]
    texts += ["x" * 499, "x" * 500, "x" * 501, "." + "x" * 600, "x" * 499 + "." + "y", "a." + "x" * 600, ""]
    assert column(texts, truncate("t")) == [expected_cut(t) for t in texts]


def test_clean_decodes_before_stripping(column):
    texts = ["a &lt;b&gt;c", "&amp;amp; <i>x</i>", "caf&eacute; &#8212; &notanentity;", None, "plain"]
    expected = [expected_cut(re.sub("<[^>]+>", "", html.unescape(t or ""))) for t in texts]
    assert column(texts, clean_snippet("t")) == expected


def test_utc_text(column):
    assert column(["0"], utc_text(F.lit(1704067261))) == ["2024-01-01 00:01:01 UTC"]


def test_hits_match_python_counting(spark):
    rng = random.Random(3)
    rows = [
        ("".join(rng.choice("abé") for _ in range(rng.randint(0, 40))),
         "".join(rng.choice("abé") for _ in range(rng.randint(1, 3))))
        for _ in range(1000)
    ]
    df = spark.createDataFrame(rows, "t string, p string")
    for r in df.select("t", "p", count_hits("t", "p").alias("n")).collect():
        assert r.n == r.t.count(r.p)


def test_words(column):
    texts = [
        "can't gonna stop! the well-known (quick) fox, 3,000 foxes; p2p.org. it's ok: yes:no a,b",
        "'hello' end... x--zed ''q'' they'd've done. 10:30 “wide” cannot",
    ]
    assert column(texts, words("t")) == [
        ["ca", "gon", "na", "stop", "quick", "fox", "foxes", "ok", "yes", "b"],
        ["end", "x", "zed", "q", "done", "wide"],
    ]


def test_unique_ratio(column):
    texts = ["alpha beta alpha", "the and of", "", "Zed"]
    assert column(texts, unique_ratio(F.lower("t"))) == [2 / 3, 0.0, 0.0, 1.0]


def test_text_relevance(column):
    def phrases(*items):
        return normalise_phrases(F.array(*map(F.lit, items)))

    score = text_relevance("t", phrases("Lido", "stETH", ""), phrases("defi"))
    texts = ["Lido lido defi", "nothing here", None, "defi defi"]
    # 20 + 1 hits at 2 distinct of 3 words; 2 hits at 1 distinct of 2 words
    assert column(texts, score) == [21 * (1 + 2 / 3), 0.0, 0.0, 2 * 1.5]


def test_phrases_are_normalised(spark):
    df = spark.createDataFrame([(["A", None, "", "b"],), (None,)], "p array<string>")
    assert [r.p for r in df.select(normalise_phrases("p").alias("p")).collect()] == [["a", "b"], []]


def test_round_score(column):
    values = [F.lit(v) for v in (2.675, 6.494999, 6.495, 10.0)]
    expected = [2.68, 6.49, 6.5, 10.0]
    got = [column(["x"], round_score(v))[0] for v in values]
    assert all(abs(a - b) <= 0.01 for a, b in zip(got, expected))
