"""URL filtering by listed rules, and by association rules mined from labels.

A URL is a set of tokens: its scheme, the labels of its host, the parts of its path and the
names in its query.  FP-growth finds combinations of tokens that labelled URLs share, and
keeps those that tell bad from good ones with enough support and confidence.  They are
matched by an inverted index from tokens to rules.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsweave.llm.shared import bounded_batches, written

# The list of (verdict, host, path) rules.
LISTED = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
LEAST_SUPPORT, LEAST_COUNT = 0.005, 5
LEAST_CONFIDENCE, LEAST_LIFT = 0.8, 1.1
# The index goes to every task up to so many rules; more are joined.
MOST_RULES = 2_000
BLOCK, ALLOW = "label=block", "label=allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    return F.coalesce(F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.char_length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] | None = None) -> Column:
    """(verdict, rule) of the longest rule of a short list that fits; null where none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, on, under in sorted(rules or LISTED, key=lambda r: len(r[1] + r[2])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(under)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(on + under).alias("rule"))).otherwise(out)
    return out


def url_tokens(url: str | None) -> set[str]:
    """The tokens of a URL, numbers as one token; none for a null or a URL without a scheme."""
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return set()
    rest, _, anchor = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, _, path = rest.partition("/")
    labels = host.lower().split(".")
    tokens = {f"scheme:{scheme.lower()}", f"top:{labels[-1]}"}
    tokens |= {f"host:{x}" for x in labels[:-1] if x}
    tokens |= {f"path:{re.sub('[0-9]+', '#', x)}" for x in path.split("/") if x}
    tokens |= {f"query:{x.partition('=')[0]}" for x in query.split("&") if x}
    return tokens | ({"anchor"} if anchor else set())


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(urls: pd.Series) -> pd.Series:
    return pd.Series([sorted(url_tokens(u)) for u in urls])


RULES = "tokens array<string>, verdict string, confidence double, support double, rarest string"


def rule_table(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, verdict, confidence, support, rarest), one row per rule that labels support.

    A longer rule is surer than all shorter ones inside it.  ``rarest`` is its token that the
    fewest labelled URLs have.

    A page is labelled by the row of labels with its id: bad where quality is 0 or toxic 1.
    Repeated labels count as bad if one of them is; rows without an id or both labels are
    left out.  No labelled pages give no rules.
    """
    bad = (F.coalesce(F.col("quality"), F.lit(1)) <= 0) | (F.coalesce(F.col("toxic"), F.lit(0)) > 0)
    graded = (
        labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.max(bad).alias("bad"))
    )
    baskets = written(
        pages.select("page_id", "url")
        .join(graded, F.col("page_id") == F.col("label_id"))
        .select(F.concat(_tokens("url"), F.array(F.when(F.col("bad"), BLOCK).otherwise(ALLOW))).alias("items")),
        "baskets",
    )
    n = baskets.count()
    none = pages.sparkSession.createDataFrame([], RULES)
    if not n:
        return none
    support = max(LEAST_SUPPORT, LEAST_COUNT / n)
    if support > 1:
        return none
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=LEAST_CONFIDENCE).fit(baskets)
    verdict = F.col("consequent")[0]
    rules = written(
        model.associationRules.where(verdict.isin(BLOCK, ALLOW) & (F.size("antecedent") > 0) & (F.col("lift") >= LEAST_LIFT)).select(
            F.array_sort("antecedent").alias("tokens"), F.substring_index(verdict, "=", -1).alias("verdict"), "confidence", "support"
        ),
        "rules",
    )
    # Each proper part of a rule's tokens, by the bits of a number.
    size = F.size("tokens")
    parts = rules.select("tokens", "confidence", F.explode(F.sequence(F.lit(1).cast("long"), F.pow(F.lit(2), size).cast("long") - 2)).alias("bits")).where(size > 1)
    parts = parts.select("tokens", "confidence", F.filter("tokens", lambda _, i: F.call_function("getbit", F.col("bits"), i) == 1).alias("part"))
    shorter = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("sure"))
    redundant = parts.join(shorter, "part").where("sure >= confidence").select("tokens").distinct()
    kept = rules.join(redundant, "tokens", "left_anti")
    counts = baskets.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rarest = kept.select("tokens", F.explode("tokens").alias("token")).join(counts, "token").groupBy("tokens").agg(F.min_by("token", F.struct("n", "token")).alias("rarest"))
    return written(kept.join(rarest, "tokens").select("tokens", "verdict", "confidence", "support", "rarest"), "kept-rules")


def _ordered(rules: DataFrame) -> list[tuple[tuple[str, ...], str, float, float]]:
    found = [(tuple(r["tokens"]), r["verdict"], r["confidence"], r["support"]) for r in rules.collect()]
    return sorted(found, key=lambda r: (-r[2], -r[3], len(r[0]), r[0]))


def mined_rules(pages: DataFrame, labels: DataFrame) -> list[tuple[tuple[str, ...], str, float, float]]:
    """(tokens, verdict, confidence, support) of all rules that labels support, the best first."""
    return _ordered(rule_table(pages, labels))


def _joined(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages with the verdict and tokens of the first rule in order that fits the url, by a join on the rules' rarest tokens."""
    urls = pages.where(F.col("url").isNotNull()).select(F.col("url").alias("__url")).distinct()
    tokens = written(urls.select("__url", _tokens("__url").alias("has")), "url-tokens")
    near = tokens.select("__url", "has", F.explode("has").alias("rarest")).join(rules, "rarest")
    order = F.struct(-F.col("confidence"), -F.col("support"), F.size("tokens"), "tokens")
    mined = F.struct("verdict", F.array_join("tokens", " & ").alias("mined_rule"))
    first = near.where(F.size(F.array_except("tokens", "has")) == 0).groupBy("__url").agg(F.min_by(mined, order).alias("mined"))
    return pages.join(first, F.col("url") == F.col("__url"), "left").drop("__url")


class RuleIndex:
    """Finds the first rule in order whose tokens a URL has, by postings from tokens to rules."""

    def __init__(self, rules: list[tuple[tuple[str, ...], str, float, float]]):
        self.rules, self.postings = rules, defaultdict(list)
        for i, rule in enumerate(rules):
            for token in rule[0]:
                self.postings[token].append(i)

    def first(self, tokens: set[str]) -> int | None:
        seen: dict[int, int] = defaultdict(int)
        for token in tokens:
            for i in self.postings.get(token, ()):
                seen[i] += 1
        return min((i for i, n in seen.items() if n == len(self.rules[i][0])), default=None)


def judged(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, url, host, path, rule, mined_rule, verdict), one row per row of pages.

    A listed rule that fits decides; else the surest mined rule whose tokens the URL has;
    else the URL is allowed.  A null URL and one without ``://`` have an empty host and path,
    fit no rule and are allowed.  Rows are judged one by one, so null and repeated ids don't
    matter; other columns aren't read.
    """
    bounded_batches(pages.sparkSession)
    rules = rule_table(pages, labels)
    few = rules.count() <= MOST_RULES
    shared = pages.sparkSession.sparkContext.broadcast(_ordered(rules) if few else [])

    @F.pandas_udf("verdict string, mined_rule string")
    def mined(urls: pd.Series) -> pd.DataFrame:
        index = RuleIndex(shared.value)
        found = [index.first(url_tokens(u)) for u in urls]
        return pd.DataFrame({
            "verdict": [None if i is None else index.rules[i][1] for i in found],
            "mined_rule": [None if i is None else " & ".join(index.rules[i][0]) for i in found],
        }, dtype=object)

    url = F.col("url")
    pages = pages.select("page_id", "url")
    pages = pages.withColumn("mined", mined(url)) if few else _joined(pages, rules)
    parts = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), "mined")
    listed = parts.withColumn("listed", listed_rule(F.col("host"), F.col("path")))
    return listed.select(
        "page_id",
        "url",
        "host",
        "path",
        F.col("listed.rule").alias("rule"),
        F.when(F.col("listed").isNull(), F.col("mined.mined_rule")).alias("mined_rule"),
        F.coalesce("listed.verdict", "mined.verdict", F.lit("allow")).alias("verdict"),
    )
