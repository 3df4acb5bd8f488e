"""Relevance scoring as column expressions: phrase hits, word variety, score."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnOrName, bind, col
from .wordlists import SPLIT_WORDS, STOP_WORDS

KEYWORD_WEIGHT = 10
MAX_SCORE = 10.0
MAX_DAY_BONUS = 5.0
SINGLE_ARTICLE_BONUS = 1.0

# Wide white space and quotation marks, made plain before splitting: classes
# limited to Latin-1 characters are matched by table lookup and scan far faster.
WIDE_CHARS = (
    "“”‘’„\u1680\u2028\u2029\u202f\u205f\u3000"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
)
SPACE_CHARS = r" \t\n\x0B\f\r\x1C\x1D\x1E\x1F\x85\xA0"
CUT_CHARS = r"\[\](){}<>\"`;@#$%&?!*«»"

# What stands between two words: gaps, a comma or colon without a digit after it,
# runs of dots, dashes or quotes, a closing full stop, and a clitic.
_GAP = rf"[{SPACE_CHARS}{CUT_CHARS}]|[:,](?![0-9])|\.\.+|--+|''+"
_EDGE = rf"(?:{_GAP}|\z)"
_STOP = rf"\.(?='?{_EDGE})"
_CLITIC = rf"(?:'(?:s|m|d|ll|re|ve)?|n't)(?=(?:\.'?)?{_EDGE})"
# the look-ahead rejects most letters with a single test
BETWEEN_WORDS = rf"(?=[{SPACE_CHARS}{CUT_CHARS}:,.\-'n])(?:{_GAP}|{_STOP}|{_CLITIC})+"

# A counted word: letters and digits only, and no stop word.  ASCII is the common case,
# and is taken without a look at Unicode's classes.
WORD = r"^[a-z0-9]*+[\p{L}\p{N}]*+$"
NOT_COUNTED = ["", *STOP_WORDS]

_GLUED = r"\b(" + "|".join(rf"{a}(?={b}\b)" for a, b in SPLIT_WORDS) + ")"


def count_hits(text: ColumnOrName, phrase: ColumnOrName) -> Column:
    """Non-overlapping occurrences of a non-empty phrase; both lower-cased."""
    text, phrase = col(text), col(phrase)
    removed = F.octet_length(text) - F.octet_length(
        F.replace(text, phrase, F.lit(""))
    )
    hits = (removed / F.octet_length(phrase)).cast("bigint")
    return F.when(F.contains(text, phrase), hits).otherwise(F.lit(0).cast("bigint"))


def sum_hits(text: Column, phrases: Column) -> Column:
    """Hits of every phrase of an array column, added up."""
    return F.aggregate(
        phrases, F.lit(0).cast("bigint"), lambda acc, p: acc + count_hits(text, p)
    )


def normalise_phrases(phrases: ColumnOrName) -> Column:
    """Lower-case a phrase array and leave out null and empty phrases."""
    phrases = F.coalesce(col(phrases), F.array().cast("array<string>"))
    return F.filter(
        F.transform(phrases, F.lower), lambda p: F.coalesce(F.length(p), F.lit(0)) > 0
    )


def words(text: ColumnOrName) -> Column:
    """Alphanumeric word tokens of a lower-cased text, stop words left out.

    Follows a Penn-Treebank tokenizer as far as it can be seen here: its other
    tokens hold a character that is no letter or digit, and are not counted.
    """
    def unglue(t: Column) -> Column:
        glued = reduce(or_, (F.contains(t, F.lit(a + b)) for a, b in SPLIT_WORDS))
        return F.when(glued, F.regexp_replace(t, _GLUED, "$1 ")).otherwise(t)

    # wide characters take more than one byte
    ascii = F.octet_length(col(text)) == F.char_length(col(text))
    plain = F.when(ascii, col(text)).otherwise(F.translate(col(text), WIDE_CHARS, " " * len(WIDE_CHARS)))
    split = F.split(bind(plain, unglue), BETWEEN_WORDS)
    # a set of literals is one hash look-up a word
    return F.filter(split, lambda w: ~w.isin(NOT_COUNTED) & w.rlike(WORD))


def unique_ratio(text: ColumnOrName) -> Column:
    """Distinct words over words, 0 for a text without words."""
    ratio = bind(
        words(text), lambda w: F.try_divide(F.size(F.array_distinct(w)), F.size(w))
    )
    return F.coalesce(ratio, F.lit(0.0))


def base_score(keyword_hits: Column, phrase_hits: Column) -> Column:
    return (keyword_hits * KEYWORD_WEIGHT + phrase_hits).cast("double")


def weigh(base: Column, ratio: Column) -> Column:
    """Scale a base score by word variety; the ratio is not computed for 0."""
    return F.when(base > 0, base * (1 + ratio)).otherwise(F.lit(0.0))


def decided(bases: Column, bonus: Column, ratios: Callable[[], Column]) -> Column:
    """Final score of the base scores of the three fields.

    Word variety lies between 0 and 1, and a larger one never gives a smaller score.  Where
    both ends give the same, as with no hits or with the highest score, that is it;
    ``ratios`` is looked at only elsewhere.
    """
    return bind(
        lowest_score(bases, bonus),
        lambda low: F.when(low == highest_score(bases, bonus), low).otherwise(
            bind(ratios(), lambda r: final_score(combine_weighed(bases, r), bonus))
        ),
    )


def lowest_score(bases: Column, bonus: Column) -> Column:
    return final_score(combine(bases), bonus)


def highest_score(bases: Column, bonus: Column) -> Column:
    return final_score(bind(F.transform(bases, lambda b: weigh(b, F.lit(1.0))), combine), bonus)


def combine_weighed(bases: Column, ratios: Column) -> Column:
    return bind(F.transform(bases, lambda b, i: weigh(b, F.get(ratios, i))), combine)


def text_relevance(text: ColumnOrName, keywords: Column, phrases: Column) -> Column:
    """Score of one text; ``keywords`` and ``phrases`` are normalised arrays."""
    lowered = F.lower(F.coalesce(col(text), F.lit("")))
    return bind(
        lowered,
        lambda t: bind(
            base_score(sum_hits(t, keywords), sum_hits(t, phrases)),
            lambda base: weigh(base, unique_ratio(t)),
        ),
    )


def combine(scores: Column) -> Column:
    """Blend ``[title, snippet, full text]``; the full text counts only if it scores."""
    title, snippet, full = (scores[i] for i in range(3))
    return F.when(full > 0, (title * 3 + snippet * 2 + full) / 6).otherwise(
        (title * 2 + snippet) / 3
    )


def content_relevance(
    title: ColumnOrName,
    snippet: ColumnOrName,
    full_content: ColumnOrName,
    keywords: Column,
    phrases: Column,
) -> Column:
    # one lambda for the three texts keeps the plan a third of the size
    texts = F.array(col(title), col(snippet), col(full_content))
    scores = F.transform(texts, lambda t: text_relevance(t, keywords, phrases))
    return bind(scores, combine)


def round_score(c: Column) -> Column:
    """Two decimals, half up on the binary value."""
    return F.floor(c * 100 + 0.5) / 100


def relevance_score(
    title: ColumnOrName,
    snippet: ColumnOrName,
    full_content: ColumnOrName,
    keywords: Column,
    phrases: Column,
    bonus: Column,
) -> Column:
    """``final_score`` of ``content_relevance``, without word variety where it decides nothing."""
    lowered = F.transform(
        F.array(col(title), col(snippet), col(full_content)), lambda t: F.lower(F.coalesce(t, F.lit("")))
    )

    def score(texts: Column) -> Column:
        bases = F.transform(texts, lambda t: base_score(sum_hits(t, keywords), sum_hits(t, phrases)))

        def ratios(b: Column) -> Column:
            return F.transform(texts, lambda t, i: F.when(F.get(b, i) > 0, unique_ratio(t)).otherwise(F.lit(0.0)))

        return bind(bases, lambda b: decided(b, bonus, lambda: ratios(b)))

    return bind(lowered, score)


def final_score(content: Column, bonus: Column) -> Column:
    return round_score(F.least(content + bonus, F.lit(MAX_SCORE)))
