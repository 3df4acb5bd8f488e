"""Toxicity: the automaton against edit distances, held-out accuracy, odd rows."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweave.llm import toxicity
from newsweave.llm.shared import table
from newsweave.llm.toxicity import Automaton, edits_allowed, features, fit, scores, unoffending
from workload.check import ROOT

DOCS = "doc_id long, text string, toxicity string"
LABELS = "doc_id long, quality int, toxic int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_automaton_is_the_edit_distance():
    rng = random.Random(14)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = [(word(rng.randint(3, 11)), False) for _ in range(25)] + [(word(k), True) for k in (4, 5, 7, 8)]
    automaton = Automaton(terms)
    for _ in range(4000):
        text = word(rng.randint(1, 13))
        found = []
        for term, stem in terms:
            ends = [text[:k] for k in range(len(text) + 1)] if stem else [text]
            near = min(distance(term, e) for e in ends)
            if near <= edits_allowed(term, stem):
                found.append(near)
        assert automaton.edits(text) == min(found, default=None), text


def test_context():
    automaton = Automaton([("scoundrel", False)])
    assert features("You scoundrel!", automaton) == (1, 0, 0, 0)
    assert features("You scoundrl, scoumdrels", automaton) == (0, 0, 2, 0)
    assert features('They said "scoundrel" once', automaton) == (0, 1, 0, 0)
    assert features("The word scoundrel was used", automaton) == (0, 1, 0, 0)
    assert features(None, automaton) == features("", automaton) == features("nice", automaton) == (0, 0, 0, 0)


def made(n=1500, seed=15):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["z" + "".join(rng.choice("aeioukrt") for _ in range(rng.randint(2, 6))) for _ in range(40)]
        toxic = rng.random() < 0.2
        if toxic:
            words[rng.randrange(40)] = rng.choice(["blockhead", "nitwit", "numskull"])
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_catches_terms_and_misspellings(spark):
    docs, labels = made()
    df, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], LABELS)
    model = fit(df, lab)
    got = {r.doc_id: r.toxicity for r in scores(df, model).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, _, t in labels)
    odd = [(0, None, ""), (1, "", ""), (2, "you blokhead", ""), (3, "nothing " * 60_000, ""), (None, "you NUMSKULL", ""), (4, 'called "nitwit" in a quote', "")]
    found = {r.doc_id: r.toxicity for r in scores(spark.createDataFrame(odd, DOCS), model).collect()}
    assert found[0] == found[1] == found[3] < 0.5 <= found[None]
    # one misspelled word speaks for it, less than an exact one
    assert found[3] < found[2] < found[None]
    kept = unoffending(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(1 - t for _, _, t in labels)
    assert scores(df.limit(0), model).count() == 0


def test_single_misspelled_term_is_enough(spark):
    docs, labels = made()
    model = fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    odd = [(0, "you blokhead", ""), (1, "a nitwitt", ""), (2, "numzkull here", ""), (3, "nothing here", "")]
    found = {r.doc_id: r.toxicity >= 0.5 for r in scores(spark.createDataFrame(odd, DOCS), model).collect()}
    assert found == {0: True, 1: True, 2: True, 3: False}


def test_misspelling_inside_a_stem(spark):
    docs, labels = made()
    rng = random.Random(16)
    ends = ["head", "heads", "heading", "headed", "ette", "ettes", "ishly", "ishness"]
    docs = [(i, text.replace(word, "block" + rng.choice(ends)), x) for i, text, x in docs for word in [next((w for w in text.split() if w[0] != "z"), "-")]]
    terms, _, _ = model = fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert any(stem and "blockhead".startswith(term) for term, stem in terms) and ("blockheading", False) in terms
    odd = [(0, "you blockhead", ""), (1, "you blpckhead", ""), (2, "a blckishness", ""), (3, "blockxyz here", ""), (4, "nothing here", "")]
    found = {r.doc_id: r.toxicity >= 0.5 for r in scores(spark.createDataFrame(odd, DOCS), model).collect()}
    assert found == {0: True, 1: True, 2: True, 3: True, 4: False}


def test_words_beside_exceptions():
    automaton = Automaton([("blockhead", False)], ["brickhead"])
    words = ["blockhead", "blokhead", "blokheat", "brockhead", "brikhead", "brickheads", "brickhead", "blickheat"]
    assert [automaton.edits(w) for w in words] == [0, 1, 2, 1, None, None, None, 2]


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, None)]])
def test_without_both_labels(spark, labels):
    df = spark.createDataFrame([(1, "a b", ""), (2, None, "")], DOCS)
    model = fit(df, spark.createDataFrame(labels, LABELS))
    assert all(0 <= r.toxicity < 0.5 for r in scores(df, model).collect())


@pytest.mark.skipif(not os.path.isdir(f"{ROOT}/sf0.1"), reason="no test data")
def test_held_out_accuracy(spark):
    docs, labels = (table(spark, f"{ROOT}/sf0.1", n) for n in ("documents", "labels"))
    held = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    got = scores(docs.select("doc_id", "text"), fit(docs, labels)).where(held).join(labels, "doc_id").toPandas()
    bad, good = got[got.toxic == 1].toxicity.to_numpy(), got[got.toxic == 0].toxicity.to_numpy()
    auc = np.mean((bad[:, None] > good) + 0.5 * (bad[:, None] == good))
    assert auc > 0.94 and np.mean(bad >= 0.5) > 0.88 and np.mean(good >= 0.5) < 0.01


def test_states_are_forgotten_and_found_again(monkeypatch):
    terms = [("blockhead", False), ("dimwitted", False), ("scumbag", True)]
    rng = random.Random(5)
    letters = "blockheadimwtsug"
    words = []
    for _ in range(2000):
        word = rng.choice(terms)[0]
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word))
            word = word[:at] + rng.choice(["", rng.choice(letters), word[at] * 2]) + word[at + 1 :]
        words.append(word)
    kept = toxicity.Automaton(terms, ["blockade"])
    expected = [kept.edits(w) for w in words]
    monkeypatch.setattr(toxicity, "KEPT_STATES", 20)
    bounded = toxicity.Automaton(terms, ["blockade"])
    assert [bounded.edits(w) for w in words] == expected
    longest = max(map(len, words))
    assert len(bounded.members) <= 20 + longest < len(kept.members)


def test_words_beside_an_exception(monkeypatch):
    automaton = toxicity.Automaton([("blockheads", False)], ["blackheads"])
    # two edits from the term and one from the exception, by each kind of edit
    for word in ("blackhead", "blackheadss", "blackheats", "lackheads"):
        assert automaton.edits(word) is None
    assert automaton.edits("blokheds") == 2


def test_columns_of_any_name_are_kept(spark):
    docs = spark.createDataFrame([(1, "a fine text", "x", "y")], "doc_id long, text string, toxicity string, __toxicity string")
    kept = unoffending(docs, spark.createDataFrame([], LABELS))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "a fine text", "x", "y")]
