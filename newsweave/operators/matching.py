"""Scoring articles that belong to no token yet against every token's phrases.

Pairing every article with every token is never needed: a pair without a phrase hit
scores exactly the day bonus.  Two exact ways find the pairs that do score, and give the
same rows for any input:

``grams``   For any registry, and what is used unless asked otherwise.  Character trigrams
            of the text are equi-joined to one trigram per phrase, the rarest in texts;
            trigrams that no phrase needs stay out of the shuffle.
            A text meets all its candidates at once and is measured there; scores are
            summed by equi-joins and partial aggregation.
``inline``  For a caller who knows that the registry is small.  It is one literal of the
            plan; each article is scored where it lies and only pairs at or above the
            token's threshold are emitted.  No join and no shuffle.

A score follows from the texts alone, so ``grams`` works on distinct texts; articles need
no key, and may share texts or anything else.

Tokens whose threshold does not exceed the bonus keep every article.  There every
pair is an output row, by the meaning of the threshold.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bind, join_spread, with_computed
from ..functions.relevance import (
    KEYWORD_WEIGHT,
    SINGLE_ARTICLE_BONUS,
    count_hits,
    decided,
    highest_score,
    lowest_score,
    relevance_score,
    unique_ratio,
)

INLINE_TOKENS = 500
INLINE_PHRASES = 2000
GRAM = 3
# bits that tell which grams are looked for: 128 KB
GRAM_SLOTS = 1 << 20
# up to so many grams are looked for one by one, of more a text is cut into all its grams
LISTED_GRAMS = 256
# one text in so many says which grams are rare; the pairs found are the same whatever it says
COUNTED = 64
TOKEN_LIST = "array<struct<token_key:string,threshold:double,weights:map<string,int>>>"
FIELDS = ["title", "snippet", "full_content"]
# joins phrases of different fields apart; no phrase holds it
BREAK = "\u0000"


def pair_score(bonus: float | Column = SINGLE_ARTICLE_BONUS) -> Column:
    """Score of an article row that already carries its token's phrase arrays."""
    bonus = bonus if isinstance(bonus, Column) else F.lit(bonus)
    return relevance_score(*FIELDS, F.col("keywords"), F.col("phrases"), bonus)


def score_assigned(articles: DataFrame, tokens: DataFrame) -> DataFrame:
    """Score rows that carry a ``token_key``; an existing score is kept.

    Adds ``threshold``.  Rows of tokens no longer in the registry drop out.
    """
    dims = tokens.select("token_key", "keywords", "phrases", "threshold")
    score = F.when(F.col("relevance").isNotNull(), F.col("relevance")).otherwise(
        pair_score()
    )
    assigned = join_spread(articles, dims, ["token_key"], articles.columns)
    return with_computed(assigned, "relevance", score).drop(
        "keywords", "phrases"
    )


def match_tokens(
    articles: DataFrame, tokens: DataFrame, *, strategy: str = "grams"
) -> DataFrame:
    """Articles paired with the tokens they are relevant to: ``+ token_key, relevance``.

    ``relevance`` of ``articles`` is ignored.  ``inline`` refuses a registry beyond its
    limits, and looks at no more rows than that.
    """
    articles = articles.drop("relevance")
    if strategy not in ("inline", "grams"):
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy == "grams":
        return _match_grams(articles, tokens)
    registry = _small_registry(tokens)
    if registry is None:
        raise ValueError("the registry is too large to be part of the plan")
    return _match_inline(articles, registry)


def _small_registry(tokens: DataFrame) -> list | None:
    """The registry rows, or null when they exceed the inline limits."""
    rows = (
        tokens.select("token_key", "keywords", "phrases", "threshold")
        .limit(INLINE_TOKENS + 1)
        .collect()
    )
    size = sum(len(r.keywords) + len(r.phrases) for r in rows)
    return rows if len(rows) <= INLINE_TOKENS and size <= INLINE_PHRASES else None


def _lowered() -> Column:
    fields = F.array(*(F.col(f) for f in FIELDS))
    return F.transform(fields, lambda f: F.lower(F.coalesce(f, F.lit(""))))


def _hits(texts: Column, phrases: Column) -> Column:
    """``array<struct<phrase, counts>>`` of the phrases found, counted per field."""
    counted = F.transform(
        phrases,
        lambda p: F.struct(
            p.alias("phrase"), F.transform(texts, lambda t: count_hits(t, p)).alias("counts")
        ),
    )
    return F.filter(counted, lambda h: F.exists(h["counts"], lambda n: n > 0))


def _ratios(texts: Column, hits: Column) -> Column:
    """Word variety per field, worked out only for fields with a hit."""
    return F.transform(
        texts,
        lambda t, i: F.when(
            F.exists(hits, lambda h: F.get(h["counts"], i) > 0), unique_ratio(t)
        ).otherwise(F.lit(0.0)),
    )


def _highest(bases: str | Column) -> Column:
    return highest_score(F.col(bases) if isinstance(bases, str) else bases, F.lit(SINGLE_ARTICLE_BONUS))


def _open(bases: Column, threshold: Column) -> Column:
    """Whether word variety decides the score, and the score may reach the threshold."""
    high = _highest(bases)
    return (high >= threshold) & (high > lowest_score(bases, F.lit(SINGLE_ARTICLE_BONUS)))


# -- inline ------------------------------------------------------------------------


def _weights(row) -> dict[str, int]:
    weights: dict[str, int] = {}
    for phrase in row.keywords:
        weights[phrase] = weights.get(phrase, 0) + KEYWORD_WEIGHT
    for phrase in row.phrases:
        weights[phrase] = weights.get(phrase, 0) + 1
    return weights


def _match_inline(articles: DataFrame, registry: list) -> DataFrame:
    phrases = sorted({p for row in registry for p in _weights(row)})
    token_rows = [
        {"token_key": r.token_key, "threshold": r.threshold, "weights": _weights(r)}
        for r in registry
    ]
    # constant folding turns both into plain literals
    phrase_list = F.from_json(F.lit(json.dumps(phrases)), "array<string>")
    token_list = F.from_json(F.lit(json.dumps(token_rows)), TOKEN_LIST)

    def weight(token: Column, hit: Column) -> Column:
        return F.coalesce(F.try_element_at(token["weights"], hit["phrase"]), F.lit(0))

    def field_bases(token: Column, hits: Column) -> Column:
        nothing = F.lit(0).cast("bigint")
        return F.transform(
            F.sequence(F.lit(0), F.lit(len(FIELDS) - 1)),
            lambda i: F.aggregate(
                hits, nothing, lambda acc, h: acc + weight(token, h) * F.get(h["counts"], i)
            ).cast("double"),
        )

    def based(hits: Column) -> Column:
        return F.transform(
            token_list,
            lambda t: F.struct(
                t["token_key"].alias("token_key"),
                t["threshold"].alias("threshold"),
                field_bases(t, hits).alias("bases"),
            ),
        )

    def relevant(tokens: Column, ratios: Column) -> Column:
        scored = F.transform(
            tokens,
            lambda t: F.struct(
                t["token_key"].alias("token_key"),
                t["threshold"].alias("threshold"),
                decided(t["bases"], F.lit(SINGLE_ARTICLE_BONUS), lambda: ratios).alias("relevance"),
            ),
        )
        return F.filter(scored, lambda s: s["relevance"] >= s["threshold"])

    def measured(texts: Column, hits: Column, tokens: Column) -> Column:
        """Word variety per field, of texts of which a token's score depends on it."""
        nothing = F.array(*(F.lit(0.0) for _ in FIELDS))
        needed = F.exists(tokens, lambda t: _open(t["bases"], t["threshold"]))
        return F.when(needed, _ratios(texts, hits)).otherwise(nothing)

    matches = bind(
        _lowered(),
        lambda texts: bind(
            _hits(texts, phrase_list),
            lambda hits: bind(
                based(hits),
                lambda tokens: bind(measured(texts, hits, tokens), lambda r: relevant(tokens, r)),
            ),
        ),
    )
    # the outer form keeps the optimizer from copying the expression into a filter
    return (
        articles.select("*", F.explode_outer(matches).alias("_match"))
        .filter("_match is not null")
        .select("*", "_match.token_key", "_match.relevance")
        .drop("_match")
    )


# -- grams -------------------------------------------------------------------------


def _grams(text: Column, length: int) -> Column:
    """Overlapping character n-grams; a zero-width match moves on by one."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{length}}}))"), F.lit(1))


def _phrase_roles(tokens: DataFrame) -> DataFrame:
    """``phrase, profile, token_key, keyword, phrases``: what a phrase counts for.

    Additional phrases are often shared by very many tokens.  Tokens with the same
    list form one profile, and a profile is scored once per article: its rows have no
    ``token_key``.
    """
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    keyword_rows = tokens.select(
        F.explode("keywords").alias("phrase"), "profile", "token_key", one.alias("k"), zero.alias("p")
    )
    profile_rows = (
        tokens.select("profile", "phrases")
        .dropDuplicates(["profile"])
        .select(
            F.explode("phrases").alias("phrase"),
            "profile",
            F.lit(None).cast("string").alias("token_key"),
            zero.alias("k"),
            one.alias("p"),
        )
    )
    return (
        keyword_rows.unionByName(profile_rows)
        .groupBy("phrase", "profile", "token_key")
        .agg(F.sum("k").alias("k"), F.sum("p").alias("p"))
    )


def _text_key() -> Column:
    """What tells the texts of articles apart, letter case aside: 128 bits."""
    return F.substring(F.unhex(F.sha2(F.array_join(_lowered(), BREAK), 256)), 1, 16)


def _phrase_grams(roles: DataFrame) -> DataFrame:
    """``phrase, gram``: every trigram of a phrase, or all of a shorter one."""
    grams = F.when(F.length("phrase") < GRAM, F.array("phrase")).otherwise(_grams(F.col("phrase"), GRAM))
    phrases = roles.select("phrase").where("phrase != ''").distinct()
    return phrases.select("phrase", F.explode(F.array_distinct(grams)).alias("gram"))


def _slots_of(grams: DataFrame) -> Column:
    """A bitmap of the grams' hashes as one value of the plan, an array of longs.

    Its size is fixed.  Grams are of three characters at most, so they are few however
    many phrases there are; a full bitmap lets more through and loses nothing.
    """
    slot = _slot(F.col("gram"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot % 64)
    taken = grams.groupBy((slot / 64).cast("bigint").alias("id")).agg(F.bit_or(bit).alias("bits"))
    every = grams.sparkSession.range(0, GRAM_SLOTS // 64, 1, 1).join(taken, "id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    return every.agg(ordered["bits"].alias("slots")).scalar()


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_SLOTS)).cast("int")


def _gram_rows(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``text_key, gram``: the wanted grams of each text, and few others.

    Few wanted grams are looked for one by one, which is the cheaper way.  For more, one
    scan takes up to three characters at each place; shorter grams are beginnings of
    these.  What the bitmap of the wanted ones doesn't know goes before any shuffle.
    """
    few = wanted.select("gram").distinct().limit(LISTED_GRAMS + 1).agg(F.collect_list("gram").alias("few")).scalar()

    def beginnings(longest: Column, n: int) -> Column:
        return F.array_distinct(F.transform(longest, lambda g: F.substring(g, 1, n)))

    def cut(text: Column) -> Column:
        scanned = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{GRAM}}}))"), F.lit(1))
        return bind(
            F.array_distinct(scanned),
            lambda longest: F.array_distinct(F.concat(longest, *(beginnings(longest, n) for n in range(1, GRAM)))),
        )

    held = bind(
        F.array_join(_lowered(), BREAK),
        lambda text: F.when(
            F.size("few") <= LISTED_GRAMS, F.filter("few", lambda g: F.contains(text, g))
        ).otherwise(cut(text)),
    )
    at = _slot(F.col("gram"))
    bits = F.get(_slots_of(wanted), (at / 64).cast("int"))
    # a subquery can't stand in a lambda
    asked = with_computed(texts.select("text_key", *FIELDS), "few", few)
    return asked.select("text_key", F.explode(held).alias("gram")).where(
        F.call_function("shiftright", bits, at % 64).bitwiseAND(1) == 1
    )


def _anchors(texts: DataFrame, roles: DataFrame) -> DataFrame:
    """``phrase, gram``: of each phrase the gram that the fewest of the counted texts have.

    Any gram of a phrase finds all its texts, a rare one finds few others.  So how often
    grams occur is counted in a share of the texts only, chosen by their keys.
    """
    grams = _phrase_grams(roles)
    counted = texts.where(F.pmod(F.xxhash64("text_key"), F.lit(COUNTED)) == 0)
    texts_with = _gram_rows(counted, grams).groupBy("gram").agg(F.count("*").alias("n"))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")
    return grams.join(texts_with, "gram", "left").groupBy("phrase").agg(F.min(rarity)["gram"].alias("gram"))


def _candidates(texts: DataFrame, roles: DataFrame) -> DataFrame:
    """``text_key, phrase``: phrases whose rarest gram occurs in the text."""
    anchors = _anchors(texts, roles)
    return join_spread(_gram_rows(texts, anchors), anchors, ["gram"], ["text_key"], like=roles).select("text_key", "phrase")


def _match_grams(articles: DataFrame, tokens: DataFrame) -> DataFrame:
    tokens = tokens.withColumn(
        "profile", F.sha2(F.to_json(F.array_sort("phrases")), 256)
    )
    selective = tokens.filter(F.col("threshold") > SINGLE_ARTICLE_BONUS)
    roles = _phrase_roles(selective)

    # verify the candidates of a text in it
    articles = articles.withColumn("text_key", _text_key())
    texts = articles.select("text_key", *FIELDS).dropDuplicates(["text_key"])
    of_text = _candidates(texts, roles).groupBy("text_key").agg(F.collect_list("phrase").alias("candidates"))
    verified = bind(_lowered(), lambda t: _hits(t, F.col("candidates")))
    hits = texts.join(of_text, "text_key").select("text_key", F.explode(verified).alias("h")).select("text_key", "h.*")

    def total(role: str) -> Column:
        sums = [F.sum(F.col(role) * F.col("counts")[i]) for i in range(len(FIELDS))]
        return F.array(*sums).alias(role)

    # phrase hits of the profile, set beside the keyword hits of its tokens
    same_profile = Window.partitionBy("text_key", "profile")
    of_profile = F.max(F.when(F.col("token_key").isNull(), F.col("p"))).over(same_profile)
    bases = F.transform(
        "k", lambda k, i: (k * KEYWORD_WEIGHT + F.coalesce(F.get("of_profile", i), F.lit(0))).cast("double")
    )
    # One row stands for one token, or for a profile, whose row is opened into tokens
    # only if it passes the lowest threshold among them on phrases alone.
    nobody = F.lit("")
    lowest = selective.groupBy("profile").agg(F.min("threshold").alias("lowest"))
    roles_of = (
        join_spread(hits, roles, ["phrase"], ["text_key"])
        .groupBy("text_key", "profile", "token_key")
        .agg(total("k"), total("p"))
        .withColumn("of_profile", of_profile)
        .select("text_key", "profile", F.coalesce("token_key", nobody).alias("stands_for"), bases.alias("bases"))
    )
    summed = join_spread(roles_of, lowest, ["profile"], ["text_key"])
    # word variety is measured once a text, in fields where a score depends on it
    rows = F.collect_list(F.struct("profile", "stands_for", "bases", "lowest")).alias("rows")
    by_text = summed.filter(_highest("bases") >= F.col("lowest")).groupBy("text_key").agg(rows)

    def depends(i: Column) -> Column:
        return F.exists("rows", lambda r: (F.get(r["bases"], i) > 0) & _open(r["bases"], r["lowest"]))

    ratios = bind(
        _lowered(),
        lambda t: F.transform(t, lambda x, i: F.when(depends(i), unique_ratio(x)).otherwise(F.lit(0.0))),
    )
    measured = (
        with_computed(texts.join(by_text, "text_key"), "ratios", ratios)
        .select("text_key", "ratios", F.explode("rows").alias("r"))
        .select("text_key", "ratios", "r.*")
    )
    relevance = decided(F.col("bases"), F.lit(SINGLE_ARTICLE_BONUS), lambda: F.col("ratios"))
    scored = with_computed(measured, "relevance", relevance)
    owners = selective.select("profile", "token_key", "threshold")
    targets = owners.withColumn("stands_for", F.col("token_key")).unionByName(
        owners.withColumn("stands_for", nobody)
    )
    passing = scored.filter("relevance >= lowest")
    passed = join_spread(passing, targets, ["profile", "stands_for"], ["text_key"]).filter("relevance >= threshold")
    # keyword hits only add to a score, so the larger one is the whole one
    pairs = passed.groupBy("text_key", "token_key").agg(
        F.max("relevance").alias("relevance")
    )
    matched = articles.join(pairs, "text_key").drop("text_key")
    articles = articles.drop("text_key")
    return matched.unionByName(_match_everything(articles, tokens).select(matched.columns))


def _match_everything(articles: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pairs of the tokens that keep every article, scored one by one.

    Every pair is a row of the output.  Tokens are copied to as many buckets as a shuffle
    has partitions and articles spread over them, so it is produced evenly.
    """
    buckets = int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dims = tokens.filter(F.col("threshold") <= SINGLE_ARTICLE_BONUS).select(
        "token_key",
        "keywords",
        "phrases",
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_bucket"),
    )
    # without such tokens no text is shuffled
    any_open = tokens.filter(F.col("threshold") <= SINGLE_ARTICLE_BONUS).agg(F.count("*")).scalar() > 0
    return (
        articles.where(any_open).withColumn("_bucket", F.pmod(F.xxhash64(*articles.columns), F.lit(buckets)).cast("int"))
        .join(dims, "_bucket")
        .withColumn("relevance", pair_score())
        .drop("_bucket", "keywords", "phrases")
    )
