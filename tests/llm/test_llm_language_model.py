"""The language model against plain dictionaries, and its tries against sorted arrays."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweave.llm import language_model
from newsweave.llm.elias_fano import EliasFano, Trie
from newsweave.llm.queries import op12_language_model
from workload.check import ROOT

SCHEMA = "doc_id long, text string, id string, words int, block int"


def brute(docs, trained):
    """(doc_id, n_tokens, n_known, train_tokens, base, score, held) in input order."""
    texts = [[*(text or "").encode().lower().split(), None] for _, text in docs]
    c1, c2, c3, of2, of3 = (collections.Counter() for _ in range(5))
    for (doc, _), words in zip(docs, texts):
        if trained(doc):
            line = ["<", "<", *words]
            c1.update(words)
            for u, v, w in zip(line, line[1:], line[2:]):
                c3[u, v, w] += 1
                c2[v, w] += 1
                of2[v] += 1
                of3[u, v] += 1
    n, known = sum(c1.values()), len(c1)
    out = []
    for (doc, _), words in zip(docs, texts):
        line, base, score = ["<", "<", *words], 0.0, 0.0
        for u, v, w in zip(line, line[1:], line[2:]):
            p1 = (c1[w] + 0.1) / (n + 0.1 * (known + 1))
            p2 = (c2[v, w] + language_model.A * p1) / (of2[v] + language_model.A)
            base += math.log10(p1)
            score += math.log10((c3[u, v, w] + language_model.B * p2) / (of3[u, v] + language_model.B))
        out.append((doc, len(words), sum(c1[w] > 0 for w in words), n, base, score))
    return out


def compare(found, expected):
    key = lambda r: tuple(-1e18 if x is None else x for x in r[:4])
    for f, e in zip(sorted(found, key=lambda r: (key(r), round(r[4], 6))), sorted(expected, key=lambda r: (key(r), round(r[4], 6)))):
        assert f[:4] == e[:4]
        assert f[4] == pytest.approx(e[4], rel=1e-9, abs=1e-9)
        # a weight and a denominator, each rounded to half a step
        assert f[5] == pytest.approx(e[5], abs=e[1] / language_model.STEP + 1e-9)
    assert len(found) == len(expected)


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0


def found(spark, docs, trained=None, **sizes):
    df = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], SCHEMA).repartition(3)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return [tuple(r) for r in language_model.scores(df, ~held_out if trained is None else trained, **sizes).collect()]


def test_whole_table(spark):
    sf_dir = f"{ROOT}/sf0.001"
    rows = op12_language_model(spark, sf_dir).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    compare([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows], brute(docs, lambda d: not held(d)))
    assert all(r.held_out == held(r.doc_id) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize("sizes", [{}, {"block_tokens": 7, "slice_tokens": 11}])
def test_odd_rows_and_many_slices(spark, sizes):
    rng = np.random.default_rng(1)
    vocabulary = ["the", "The", "of", "Ärger", "ä", "a\x0bb", "x" * 40, "x" * 41, " ", "<"]
    docs = [(i, " ".join(rng.choice(vocabulary, 12, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.025, 0.025]))) for i in range(60)]
    docs += [(None, "the of"), (60, None), (61, ""), (62, " \t\n"), (3, docs[3][1]), (3, docs[3][1])]
    docs += [(63, "the the the " * 500), (64, "new words in a held out text"), (65, "the unknown of " * 3)]
    compare(found(spark, docs, **sizes), brute(docs, lambda d: not held(d)))


def test_nothing_to_train_on(spark):
    assert found(spark, []) == []
    rows = found(spark, [(1, "a b"), (2, None)], trained=F.lit(None).cast("boolean"))
    assert sorted(r[:4] for r in rows) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert all(r[4] == 0 and r[5] == pytest.approx(0, abs=1e-9) for r in rows)


def test_probabilities_sum_to_one(spark):
    """Over all next words of a text's start: one text for each, and one for unknown words."""
    train = [(i, t) for i, t in enumerate(["a b a c", "b a", "c c a", ""]) if True]
    words = ["a", "b", "c", "zzz"]
    tests = [(100 + i, f"a {w}") for i, w in enumerate([*words, ""])]
    rows = {r[0]: r[5] for r in found(spark, train + tests, trained=F.col("doc_id") < 100)}
    ends = {r[0]: r for r in brute(train + tests, lambda d: d < 100)}
    # a text "a w" is a, w, end; take what the end adds off by brute force
    total = 0
    for i, w in enumerate(words):
        line = brute(train + [(200, f"a {w}")], lambda d: d < 100)[-1][5]
        assert rows[100 + i] == pytest.approx(line, abs=0.01)
        total += 10 ** (line - _end(train, ["a", w]))
    total += 10 ** ends[104][5]
    assert total / 10 ** _first(train, "a") == pytest.approx(1, abs=1e-9)


def _end(train, words):
    """log10 of the end behind two words."""
    whole = brute(train + [(300, " ".join(words))], lambda d: d < 100)[-1][5]
    return whole - _first(train, words[0]) - _second(train, words)


def _model(train):
    c1, c2, c3, of2, of3 = (collections.Counter() for _ in range(5))
    for _, text in train:
        line = ["<", "<", *text.encode().split(), None]
        c1.update(line[2:])
        for u, v, w in zip(line, line[1:], line[2:]):
            c3[u, v, w] += 1; c2[v, w] += 1; of2[v] += 1; of3[u, v] += 1
    n, known = sum(c1.values()), len(c1)

    def p(u, v, w):
        p1 = (c1[w] + 0.1) / (n + 0.1 * (known + 1))
        p2 = (c2[v, w] + language_model.A * p1) / (of2[v] + language_model.A)
        return math.log10((c3[u, v, w] + language_model.B * p2) / (of3[u, v] + language_model.B))

    return p


def _first(train, word):
    return _model(train)("<", "<", word.encode())


def _second(train, words):
    return _model(train)("<", words[0].encode(), words[1].encode())


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 10**12), (1000, 50), (1000, 10**6), (50_000, 10**9), (5, 2**50)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n))
    packed = EliasFano.packed(values)
    sequence = EliasFano(memoryview(packed))
    assert (sequence.get(np.arange(n)) == values).all()
    asked = np.r_[rng.integers(0, 2 * top, 500), values, values + 1, 0]
    assert (sequence.successor(asked) == np.searchsorted(values, asked)).all()
    if n >= 1000 and top >= 10**6:
        assert len(packed) * 8 < n * (math.log2(top / n) + 3.5) + 1000


def test_trie():
    rng = np.random.default_rng(2)
    tuples = np.unique(rng.integers(0, [50, 300, 1000], (20_000, 3)), axis=0)
    trie = Trie.build(*tuples.T)
    asked = np.r_[tuples, rng.integers(0, [60, 310, 1000], (20_000, 3))]
    places = trie.tuples(trie.pairs(asked[:, 0], asked[:, 1]), asked[:, 2])
    known = {tuple(t): i for i, t in enumerate(tuples.tolist())}
    assert places.tolist() == [known.get(tuple(t), -1) for t in asked.tolist()]
    nothing = Trie.build(*np.zeros((3, 0), np.int64))
    assert (nothing.tuples(nothing.pairs(asked[:, 0], asked[:, 1]), asked[:, 2]) == -1).all()


def test_words_of_long_texts_are_cut_at_blanks(monkeypatch):
    monkeypatch.setattr(language_model, "PIECE", 10)
    data = ("Abc def\tghi " * 50 + "y" * 100).encode()
    assert list(language_model.words(data)) == data.lower().split()
