"""Order MinHash: alignment, sketches and classes against brute force."""

import random

import numpy as np
import pandas as pd

from newsweave.llm.order_minhash import aligned_similarity, near_duplicates, one_of_each, parity, shingles, sketch
from newsweave.llm.words import word_hashes

SCHEMA = "doc_id long, text string, words_key string, n int"


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def similarity(a, b):
    s = common(a, b)
    return s / (len(a) + len(b) - s)


def text_shingles(text):
    return shingles(word_hashes(text.encode())).tolist()


def families(seed=2, groups=12, size=6):
    """Texts of a few families whose members differ in few to many words."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = [f"new{rng.randrange(9999)}"]
            texts.append(" ".join(own))
    return texts + [" ".join(rng.choice(words) for _ in range(50)) for _ in range(30)]


def test_alignment_is_the_longest_common_subsequence():
    rng = np.random.default_rng(5)
    reached = 0
    for _ in range(300):
        a = rng.integers(0, 30, rng.integers(1, 60)).astype(np.uint64)
        b = np.delete(a, rng.integers(0, len(a), rng.integers(0, 4)))
        b = np.insert(b, rng.integers(0, len(b) + 1, rng.integers(0, 4)), 99)
        exact = similarity(a.tolist(), b.tolist()) if len(b) else 0.0
        got = aligned_similarity(a, b)
        assert got == exact if exact >= 0.8 else got == 0.0
        reached += exact >= 0.8
        apart = sum(int(x).bit_count() for x in (parity(a) ^ parity(b)).view(np.uint64)) if len(b) else 0
        assert apart <= len(a) + len(b) - 2 * common(a.tolist(), b.tolist()) or not len(b)
    assert reached > 30


def test_classes_are_those_of_all_pairs(spark):
    texts = families()
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)]
    rows += [(len(rows) + i, rows[3][1].upper().replace(" ", ",  "), "k", 1) for i in range(40)]
    grams = [text_shingles(r[1]) for r in rows]
    leader = list(range(len(rows)))

    def find(i):
        while leader[i] != i:
            i = leader[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(grams[i], grams[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                leader[b] = a
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert dict(zip(got.doc_id, got.class_id, strict=True)) == {i: find(i) for i in range(len(rows))}
    assert set(got[got.kept].doc_id) == {find(i) for i in range(len(rows))}
    assert len({find(i) for i in range(len(rows))}) < len(rows) - 60


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [
        (1, None, "", 0), (2, "", "", 0), (3, "...", "", 0), (4, "one two", "", 0), (5, "One, two!", "", 0), (None, "one two", "", 0),
        (6, long, "", 0), (7, long + " end", "", 0), (8, "a b c d e f g h", "", 0), (8, "a b c d e f g h", "", 0), (None, "only this text", "", 0),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = near_duplicates(docs).toPandas()
    assert len(got) == len(rows)
    classes = {int(r.doc_id): r.class_id for r in got.itertuples() if not pd.isna(r.doc_id)}
    assert classes == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8}
    kept = one_of_each(docs).toPandas()
    assert sorted(kept.doc_id.dropna()) == [1, 2, 3, 4, 6, 8] and list(kept.columns) == docs.columns
    assert kept.doc_id.isna().sum() == 1
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_short_texts_at_the_threshold_share_a_sketch():
    rng = random.Random(31)
    for size, missed in ((8, 0), (12, 0), (28, 0), (60, 1)):
        lost = 0
        for _ in range(3000):
            words = [f"v{rng.randrange(10**9)}" for _ in range(size)]
            n = size - 4
            # as many words behind as the threshold allows
            longer = words + [f"v{rng.randrange(10**9)}" for _ in range(n // 4)]
            a, b = (shingles(word_hashes(" ".join(t).encode())) for t in (words, longer))
            assert aligned_similarity(a, b) >= 0.8
            one, two = sketch(a), sketch(b)
            shared = min(len(one), len(two))
            lost += not (one[:shared] == two[:shared]).any()
        assert lost <= missed
