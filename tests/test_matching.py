import random

import pytest
from pyspark.sql import functions as F

from newsweave.operators import matching
from newsweave.operators.matching import match_tokens, score_assigned
from newsweave.operators.tokens import prepare_tokens, query_plan, token_key
from newsweave.schemas import TOKEN

ARTICLE = "arrival bigint, title string, snippet string, full_content string"


def token(name, symbol, threshold=6.5, mandatory=(), additional=()):
    return (name, symbol, {"c": "0x1"}, None, threshold, list(mandatory), list(additional), None)


def registry(spark, rows):
    return prepare_tokens(
        spark.createDataFrame(rows, TOKEN).withColumn("token_key", F.col("symbol"))
    )


TOKENS = [
    token("Lido", "lido", 6.5, ["staked eth"], ["defi", "p2p.org"]),
    token("ab", "b", 4.5, [], ["defi"]),
    token("zzz", "qqq", None, [], ["defi"]),
    token("none", "nope", 2.0, [], ["defi", "defi", "a"]),
]
WORDS = ["lido", "staked", "eth", "defi", "p2p.org", "ab", "b", "a", "The", "news", "aab"]


def articles(spark, n=300):
    rng = random.Random(11)

    def text(size):
        return " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, size)))

    # a third of all articles are full of the phrase every token shares
    rows = [
        (i, text(4), "defi " * 30 if i % 3 == 0 else text(12), rng.choice([None, "", text(30)]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, ARTICLE)


def every_pair(spark, docs, tokens):
    """Brute force: all pairs, scored one by one."""
    pairs = docs.crossJoin(tokens.select("token_key")).withColumn(
        "relevance", F.lit(None).cast("double")
    )
    scored = score_assigned(pairs, tokens).filter("relevance >= threshold")
    return {(r.arrival, r.token_key, r.relevance) for r in scored.collect()}


@pytest.mark.parametrize("strategy", ["inline", "grams"])
def test_matches_are_all_pairs_that_pass(spark, strategy):
    docs, tokens = articles(spark), registry(spark, TOKENS)
    expected = every_pair(spark, docs, tokens)
    assert len(expected) > 100
    found = match_tokens(docs, tokens, strategy=strategy).collect()
    assert len(found) == len(expected)
    assert {(r.arrival, r.token_key, r.relevance) for r in found} == expected


@pytest.mark.parametrize("strategy", ["inline", "grams"])
def test_articles_need_no_key(spark, strategy):
    """Articles with one arrival, and equal texts, keep their own matches."""
    docs = articles(spark, 60).withColumn("arrival", F.lit(1).cast("bigint"))
    docs = docs.unionByName(docs.limit(5)).withColumn("n", F.lit("n"))
    tokens = registry(spark, TOKENS)
    columns = ["title", "snippet", "full_content", "token_key", "relevance"]
    pairs = docs.crossJoin(tokens.select("token_key")).withColumn("relevance", F.lit(None).cast("double"))
    expected = score_assigned(pairs, tokens).filter("relevance >= threshold").select(columns)
    found = match_tokens(docs, tokens, strategy=strategy)
    assert found.columns == [*docs.columns, "token_key", "relevance"]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, expected.collect()))


@pytest.mark.parametrize("strategy", ["inline", "grams"])
def test_low_thresholds_keep_every_article(spark, strategy):
    docs = articles(spark, 60)
    tokens = registry(spark, [*TOKENS[:1], token("open", "open", 0.5), token("one", "one", 1.0)])
    expected = every_pair(spark, docs, tokens)
    found = match_tokens(docs, tokens, strategy=strategy).collect()
    assert {(r.arrival, r.token_key, r.relevance) for r in found} == expected
    assert sum(r.token_key == "open" for r in found) == 60


def test_large_registries_do_not_become_part_of_the_plan(spark):
    tokens = registry(spark, [token(f"name {i:04d} x", f"S{i:04d}", 6.5, [], ["defi"]) for i in range(700)])
    docs = spark.createDataFrame(
        [(0, "name 0007 x and s0699", "name 0007 x", None), (1, "defi", "defi", "defi")], ARTICLE
    )
    with pytest.raises(ValueError):
        match_tokens(docs, tokens, strategy="inline")
    found = match_tokens(docs, tokens)
    assert {(r.arrival, r.token_key) for r in found.collect()} == {(0, "S0007"), (0, "S0699")}


def test_no_strategy_pairs_rows_without_a_key(spark):
    docs, tokens = articles(spark, 30), registry(spark, TOKENS)
    for strategy in ("inline", "grams"):
        plan = match_tokens(docs, tokens, strategy=strategy)._jdf.queryExecution().executedPlan()
        text = plan.toString()
        assert "CartesianProduct" not in text and "NestedLoop" not in text
        assert "Python" not in text
        assert strategy == "grams" or "Exchange" not in text


def test_existing_scores_are_kept(spark):
    tokens = registry(spark, TOKENS)
    rows = [(0, "lido", "lido", None, 3.25, "lido"), (1, "lido", "lido", None, None, "lido"), (2, "", "", "", None, "gone")]
    docs = spark.createDataFrame(rows, f"{ARTICLE}, relevance double, token_key string")
    found = {r.arrival: r.relevance for r in score_assigned(docs, tokens).collect()}
    assert found[0] == 3.25 and found[1] == 10.0 and 2 not in found


def test_scores_are_worked_out_once(spark):
    """A threshold filter must not bring a second copy of the score into the plan."""
    docs = articles(spark, 10).withColumns(
        {"relevance": F.lit(None).cast("double"), "token_key": F.lit("lido")}
    )
    scored = score_assigned(docs, registry(spark, TOKENS)).filter("relevance >= threshold")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("n't") == 1


def test_token_keys_tell_equal_symbols_apart(spark):
    rows = [
        ("A", "SYM", {"x": "0xAB", "y": "0xCD"}),
        ("B", "sym", {"y": "0xcd", "x": "0xab"}),
        ("C", "SYM", {"x": "0xEF"}),
        ("D", "SYM", None),
    ]
    df = spark.createDataFrame(rows, "name string, symbol string, address map<string,string>")
    keys = {r.name: r.k for r in df.select("name", token_key().alias("k")).collect()}
    assert keys["A"] == keys["B"] and len(set(keys.values())) == 3


def test_query_plan_lists_every_combination_shortest_first(spark):
    from itertools import combinations

    extra = ["defi", "p2p.org", "lido.fi", "x"]
    tokens = registry(spark, [token("Liquid", "stETH", 8.0, ["lido", "staked eth"], extra), token("N", "S")])
    found = query_plan(tokens).orderBy("token_key", "query_order").collect()
    base = "Liquid stETH lido staked eth"
    expected = [base] + [
        f"{base} {' '.join(c)}" for r in range(1, 5) for c in combinations(extra, r)
    ]
    assert [r.query for r in found if r.token_key == "stETH"] == expected
    assert [r.query for r in found if r.token_key == "S"] == ["N S "]


def test_query_plan_of_many_phrases(spark):
    tokens = registry(spark, [token("N", "S", None, [], [f"p{i}" for i in range(14)])])
    assert query_plan(tokens).select("query").distinct().count() == 2**14


@pytest.mark.parametrize("n", [12, 13, 16])
def test_query_plan_numbers_every_mask(spark, n):
    tokens = registry(spark, [token("N", "S", None, [], [f"p{i}" for i in range(n)])])
    plan = query_plan(tokens).agg(F.count_distinct("query_order"), F.max("query_order"), F.sum("n_phrases")).first()
    assert tuple(plan) == (2**n, n * 2**n, n * 2 ** (n - 1))


@pytest.mark.parametrize("n", [63, 64, 70])
def test_query_plan_refuses_what_it_cannot_number(spark, n):
    tokens = registry(spark, [token("N", "S", None, [], [f"p{i}" for i in range(n)])])
    with pytest.raises(Exception, match="too many additional phrases"):
        query_plan(tokens).count()


def test_a_phrase_is_looked_for_by_its_rarest_gram(spark, monkeypatch):
    monkeypatch.setattr(matching, "COUNTED", 1)
    texts = spark.createDataFrame([(0, "abc abx"), (1, "abc"), (2, "abc xyz"), (3, None)], "id int, title string")
    texts = texts.select(F.col("id").alias("text_key"), "title", *(F.lit("").alias(c) for c in ("snippet", "full_content")))
    phrases = spark.createDataFrame([("abc abx",), ("abc xyz",), ("abcd",), ("b",), ("zz",), ("",)], "phrase string")
    found = {r.phrase: r.gram for r in matching._anchors(texts, phrases).collect()}
    assert set(found) == {"abc abx", "abc xyz", "abcd", "b", "zz"}
    assert found["b"] == "b" and found["abcd"] == "bcd" and "abc" not in found.values()
    pairs = {tuple(r) for r in matching._candidates(texts, phrases).collect()}
    assert pairs == {(0, "abc abx"), (2, "abc xyz"), (0, "b"), (1, "b"), (2, "b")}


def test_only_wanted_grams_become_rows(spark):
    texts = spark.createDataFrame([(0, "the quick brown fox \U0001f600x")], "text_key int, title string")
    texts = texts.select("*", *(F.lit("").alias(c) for c in ("snippet", "full_content")))
    wanted = spark.createDataFrame([("qui",), ("x",), ("ox",), ("fo",), ("\U0001f600x",), ("cow",)], "gram string")
    rows = matching._gram_rows(texts, wanted)
    assert sorted(r.gram for r in rows.collect()) == sorted(["qui", "x", "ox", "fo", "\U0001f600x"])
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]


def test_an_empty_registry_or_table_matches_nothing(spark):
    docs, tokens = articles(spark, 20), registry(spark, TOKENS)
    assert match_tokens(docs, tokens.limit(0)).count() == 0
    assert match_tokens(docs.limit(0), tokens).count() == 0


@pytest.mark.parametrize("listed", [0, 256])
def test_grams_are_found_one_by_one_or_by_cutting(spark, monkeypatch, listed):
    monkeypatch.setattr(matching, "LISTED_GRAMS", listed)
    docs, tokens = articles(spark, 40), registry(spark, TOKENS)
    found = match_tokens(docs, tokens).collect()
    assert {(r.arrival, r.token_key, r.relevance) for r in found} == every_pair(spark, docs, tokens)


def test_scores_that_word_variety_cannot_change_need_none(spark):
    """A score between equal bounds is the one that the words would give."""
    from newsweave.functions import relevance

    rows = [(float(t), float(s), float(f), r) for t in (0, 1, 3, 20) for s in (0, 2, 9) for f in (0, 1, 7, 60) for r in (0.0, 0.4, 1.0)]
    frame = spark.createDataFrame(rows, "t double, s double, f double, r double")
    bases, ratios, one = F.array("t", "s", "f"), F.array("r", "r", "r"), F.lit(1.0)
    whole = relevance.final_score(relevance.combine_weighed(bases, ratios), one)
    fail = F.raise_error(F.lit("looked at")).cast("array<double>")
    high = frame.where("t >= 20").select(relevance.decided(bases, one, lambda: fail).alias("x"))
    assert {r.x for r in high.collect()} == {10.0}
    both = frame.select(relevance.decided(bases, one, lambda: ratios).alias("x"), whole.alias("y")).collect()
    assert all(r.x == r.y for r in both)


def test_a_few_tokens_do_not_mean_a_few_tasks(spark):
    """Rows of one token are dealt out over many partitions, and keep their scores."""
    tokens = registry(spark, TOKENS[:1])
    docs = articles(spark, 200).withColumns({"relevance": F.lit(None).cast("double"), "token_key": F.lit("lido")})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = score_assigned(docs, tokens)
        parts = {r.p for r in scored.select(F.spark_partition_id().alias("p")).distinct().collect()}
        assert len(parts) > 4 and scored.count() == 200
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
