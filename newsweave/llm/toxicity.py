"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from labelled documents: words, and stems of word families, that
occur mostly in toxic ones.  A text's words run through the automaton that accepts every
word within a few edits of a term; it is the product of the trie and the edit counts, built
state by state as words need it.  A hit inside quotation marks or beside a word of reporting
counts apart from one that addresses somebody, and a logistic model weighs the counts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.llm.shared import bounded_batches, written

# The model is fitted on about this many labelled rows, taken by a hash of the id.
FIT_ROWS = 20_000
# Evidence a term needs: the G statistic, toxic documents with it, and their share.
LEAST_G, LEAST_DOCS, LEAST_SHARE = 24.0, 4, 0.8
STEM_LENGTHS = range(4, 8)
WINDOW = 6
# Distinct words whose result a task remembers, and states of the automaton that it keeps; both are found anew when
# needed again.
REMEMBERED, KEPT_STATES = 200_000, 50_000

WORD = re.compile(r"[^\W_]+")
QUOTES = re.compile('["“”„«»]')
REPORTING = frozenset(
    "said says say saying quote quoted quotes called calls word words term phrase wrote written reported reports "
    "sagte sagt zitat wort wörter dijo dice palabra palabras cita dit disait mot mots citation".split()
)
ADDRESS = frozenset("you your youre u ur yourself du dich dir ihr euch tu te toi vous usted ustedes eres".split())
FEATURES = ["exact_abuse", "exact_quoted", "fuzzy_abuse", "fuzzy_quoted"]
# Weights before labels speak: of a base rate, and of each feature.
PRIOR = (-3.0, 4.0, 1.0, 3.0, 0.5)
# Letters that a misspelling for the fit puts in.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def edits_allowed(term: str, stem: bool) -> int:
    """Short terms have to match exactly, as one edit reaches too many words from them."""
    if stem:
        return 0 if len(term) < 7 else 1
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def _shorter(word: str) -> list[str]:
    """The word without one of its letters."""
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


class Automaton:
    """Accepts words within the allowed edits of a term; a stem accepts any ending.

    A state is a set of (trie node, edits so far); transitions are kept as they are found, up
    to KEPT_STATES states.
    """

    def __init__(self, terms: list[tuple[str, bool]], exceptions: list[str] = (), wider: int = 0):
        self.exceptions = frozenset(exceptions)
        self.letters = sorted({c for e in self.exceptions for c in e})
        self.children: list[dict[str, int]] = [{}]
        self.limit, self.whole, self.stem = [0], [-1], [-1]
        for term, stem in terms:
            node, most = 0, edits_allowed(term, stem) + wider
            self.limit[0] = max(self.limit[0], most)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.limit.append(0)
                    self.whole.append(-1)
                    self.stem.append(-1)
                node = self.children[node][c]
                self.limit[node] = max(self.limit[node], most)
            if stem:
                self.stem[node] = max(self.stem[node], most)
            else:
                self.whole[node] = max(self.whole[node], most)
        self.words: dict[str, int] = {}
        self._begin()

    def _begin(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[int] = []
        self.dead = self._state({})
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, found: dict[int, int]) -> dict[int, int]:
        """Letters of a term may be missing from the word."""
        todo = list(found.items())
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits + 1 <= self.limit[child] and edits + 1 < found.get(child, 99):
                    found[child] = edits + 1
                    todo.append((child, edits + 1))
        return found

    def _state(self, found: dict[int, int], absorbed: int = 9) -> int:
        for node, edits in found.items():
            if edits <= self.stem[node]:
                absorbed = min(absorbed, edits)
        key = frozenset([*found.items(), (-1, absorbed)])
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.moves.append({})
            whole = [e for node, e in found.items() if e <= self.whole[node]]
            self.accepts.append(min([absorbed, *whole]))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        found: dict[int, int] = {}
        absorbed = 9
        for node, edits in self.members[state]:
            if node == -1:
                absorbed = edits
                continue
            if edits + 1 <= self.limit[node]:
                found[node] = min(found.get(node, 99), edits + 1)
            for letter, child in self.children[node].items():
                cost = edits + (letter != c)
                if cost <= self.limit[child]:
                    found[child] = min(found.get(child, 99), cost)
        return self._state(self._closed(found), absorbed)

    def edits(self, word: str) -> int | None:
        """The least edits from the word to a term that accepts it; None where there is none."""
        known = self.words.get(word)
        if known is None:
            if len(self.members) >= KEPT_STATES:
                self._begin()
            state = self.start
            for c in word:
                following = self.moves[state].get(c)
                if following is None:
                    following = self.moves[state][c] = self._move(state, c)
                state = following
                if state == self.dead:
                    break
            known = self.accepts[state]
            if known and (word in self.exceptions or 1 < known < 9 and self._beside_exception(word)):
                known = 9
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[word] = known
        return known if known < 9 else None

    def _beside_exception(self, word: str) -> bool:
        """Whether an exception is one edit away: nearer than a term two edits away."""
        if not self.exceptions.isdisjoint(_shorter(word)):
            return True
        return any(
            word[:i] + c + word[j:] in self.exceptions
            for i in range(len(word) + 1)
            for j in (i, i + 1)
            for c in self.letters
        )


def features(text: str | None, automaton: Automaton) -> tuple[int, int, int, int]:
    """Hits by exactness and by context: 0 for a null or empty text."""
    if not text:
        return (0, 0, 0, 0)
    low = text.lower()
    words = WORD.findall(low)
    edits = automaton.edits
    hits = {w: e for w in set(words) if (e := edits(w)) is not None}
    if not hits:
        return (0, 0, 0, 0)
    counts = [0, 0, 0, 0]
    places = list(WORD.finditer(low))
    for i, word in enumerate(words):
        if word not in hits:
            continue
        near = words[max(0, i - WINDOW) : i + WINDOW + 1]
        first = places[max(0, i - WINDOW)].start()
        last = places[min(len(words) - 1, i + WINDOW)].end()
        quoted = bool(QUOTES.search(low, first, places[i].start()) and QUOTES.search(low, places[i].end(), last + 1))
        told = any(w in REPORTING for w in near)
        aimed = any(w in ADDRESS for w in near)
        apart = quoted or (told and not aimed)
        counts[2 * (hits[word] > 0) + apart] += 1
    return tuple(counts)


def misspelled(text: str, automaton: Automaton) -> str:
    """The text in small letters with one edit in each word that is a hit as it stands.

    The edit (a letter dropped, doubled or replaced, not the first) is told by word and place.
    """

    def typo(m: re.Match) -> str:
        word = m[0]
        if automaton.edits(word) != 0 or len(word) < 2:
            return word
        pick = zlib.crc32(f"{word} {m.start()}".encode())
        at, letter = 1 + pick % (len(word) - 1), LETTERS[pick // 64 % 26]
        return word[:at] + ("", word[at] * 2, letter)[pick // 4096 % 3] + word[at + 1 :]

    return WORD.sub(typo, text.lower())


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text) of about FIT_ROWS labelled rows of the training folds."""
    train = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    every = math.ceil(max(train.count(), 1) / FIT_ROWS)
    chosen = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(F.col("doc_id").alias("label_id"), "toxic")
    # FIT_ROWS bounds the side that is broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("toxic", "text")


def held_out() -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _term_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for toxic, text in zip(frame["toxic"], frame["text"], strict=True):
            words = set(WORD.findall((text or "").lower()))
            stems = {w[:k] + "*" for w in words for k in STEM_LENGTHS if len(w) > k}
            counts[toxic > 0].update(words | stems)
            counts[toxic > 0][""] += 1
        terms = list(counts[True] | counts[False])
        yield pd.DataFrame({"term": terms, "toxic": [counts[True][t] for t in terms], "clean": [counts[False][t] for t in terms]})


def lexicon(sample: DataFrame) -> tuple[list[tuple[str, bool]], list[str]]:
    """Terms with whether they are stems, and words that look like misspelled terms but aren't.

    Terms come from document counts of words and of their beginnings.  A stem is a term beside
    its words where they are many and the stem itself is as telling; the shortest such stem is
    taken.  Exceptions are words of clean documents that a term reaches, and those one edit
    further, as a word between both is more likely theirs.  Both come from the sample alone,
    whose size bounds what reaches the driver; none is left out.
    """
    counts = written(
        sample.mapInPandas(_term_counts, "term string, toxic long, clean long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")),
        "terms",
    )
    total = sample.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    positive, negative = float(total[0]), float(total[1])
    if not positive or not negative:
        return [], []
    p, n = F.col("toxic"), F.col("clean")
    share = F.lit(positive / (positive + negative))
    g = 2 * (p * F.log(p / ((p + n) * share)) + F.when(n > 0, n * F.log(n / ((p + n) * (1 - share)))).otherwise(0.0))
    rows = (
        counts.where((F.col("term") != "") & (p >= LEAST_DOCS))
        .where(p >= LEAST_SHARE * (p + n))
        .where(g >= LEAST_G)
        .select("term", "toxic")
        .collect()
    )
    docs_with = {r["term"]: r["toxic"] for r in rows}
    words = [t for t in docs_with if not t.endswith("*")]
    stems: list[str] = []
    for stem in sorted((t[:-1] for t in docs_with if t.endswith("*")), key=lambda t: (len(t), t)):
        family = max((docs_with[w] for w in words if w.startswith(stem)), default=0)
        if not any(stem.startswith(s) for s in stems) and family < 0.6 * docs_with[stem + "*"]:
            stems.append(stem)
    # A stem allows fewer edits than its words do, so those stay terms as well, with or without evidence of their own.
    family = F.lit(False)
    for k in STEM_LENGTHS:
        family = family | F.substring("term", 1, k).isin([s for s in stems if len(s) == k])
    related = ~F.col("term").endswith("*") & (p > 0) & (p >= LEAST_SHARE * (p + n)) & family
    relatives = counts.where(related).select("term").collect()
    terms = [(s, True) for s in stems] + [(w, False) for w in sorted({*words, *(r["term"] for r in relatives)})]

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(terms)
        wide = Automaton([t for t in terms if edits_allowed(*t) > 1], wider=1)
        for frame in frames:
            yield frame[[bool(automaton.edits(w)) or bool(wide.edits(w)) for w in frame["term"]]]

    harmless = counts.where(~F.col("term").endswith("*") & (F.col("clean") > 0) & (F.col("toxic") <= F.col("clean")))
    exceptions = harmless.select("term").mapInPandas(near, "term string").collect()
    return terms, sorted(r["term"] for r in exceptions)


def _design(counts: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(counts)), np.log1p(counts)])


def fit_weights(counts: np.ndarray, labels: np.ndarray, times: np.ndarray, prior: np.ndarray = PRIOR) -> np.ndarray:
    """Logistic regression with a Gaussian prior by Newton steps; rows count ``times`` each."""
    x, prior = _design(counts), np.array(prior)
    w = prior.copy()
    ridge = np.diag([1e-3, *[0.3] * counts.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (times * (labels - p)) - ridge @ (w - prior)
        step = np.linalg.solve((x.T * (times * p * (1 - p))) @ x + ridge, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


Model = tuple[list[tuple[str, bool]], list[str], list[float]]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The lexicon, its exceptions and the weights of the features, both small, from the labelled sample."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels)
    terms, exceptions = lexicon(sample)
    shared = docs.sparkSession.sparkContext.broadcast((terms, exceptions))

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(*shared.value)
        for frame in frames:
            texts, toxic = list(frame["text"]), (frame["toxic"].to_numpy() > 0).astype(np.int64)
            found = np.array([features(t, automaton) for t in texts], np.int64).reshape(-1, 4)
            # Labelled texts seldom have misspelled hits: those with exact ones count once more, misspelled.
            exact = np.flatnonzero(found[:, :2].sum(axis=1))
            typos = np.array([features(misspelled(texts[i], automaton), automaton) for i in exact], np.int64).reshape(-1, 4)
            caught = typos[:, 2:].sum(axis=1) > 0
            found, toxic = np.concatenate([found, typos[caught]]), np.concatenate([toxic, toxic[exact[caught]]])
            yield pd.DataFrame(found, columns=FEATURES).assign(toxic=toxic)

    schema = ", ".join(f"{c} long" for c in [*FEATURES, "toxic"])
    # At most two rows for each of the sample.
    grouped = sample.mapInPandas(rows, schema).groupBy(*FEATURES, "toxic").count().toPandas()
    if grouped["toxic"].nunique() < 2:
        # Nothing to tell apart: every text gets the share of the one label seen.
        return [], [], [-6.0 if not len(grouped) or grouped["toxic"].iloc[0] == 0 else 6.0, 0.0, 0.0, 0.0, 0.0]
    grouped = grouped.sort_values([*FEATURES, "toxic"])
    weights = fit_weights(*(grouped[c].to_numpy(float) for c in (FEATURES, "toxic", "count")))
    # A hit never speaks for a text.
    return terms, exceptions, [float(weights[0]), *np.maximum(weights[1:], 0.0).tolist()]


def _score(docs: DataFrame, model: Model) -> Column:
    """The score of each row's text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms, exceptions, weights = shared.value
        automaton = Automaton(terms, exceptions)
        for texts in batches:
            counts = np.array([features(t, automaton) for t in texts], float).reshape(-1, 4)
            z = _design(counts) @ np.array(weights)
            yield pd.Series(1 / (1 + np.exp(-z)))

    return toxicity("text")


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column ``toxicity`` from 0 to 1, from the whole text alone.

    Null and empty texts and texts without hits get the model's base rate; so do all texts
    where labels were missing or all alike.  Rows are scored one by one, so nulls, repeated
    rows and other columns don't matter; a column named toxicity is replaced.
    """
    return docs.withColumn("toxicity", _score(docs, model))


def unoffending(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns whatever their names, that don't score 0.5 or more."""
    return docs.where(_score(docs, fit(docs, labels)) < 0.5)
