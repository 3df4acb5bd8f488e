"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from newsweave.llm import turn_trie

SCHEMA = "conv_id long, turn long, role string, text string, id string, key int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t[3] for t in sorted(ts, key=lambda t: (t[0], t[1] or 0, t[2]))] for c, ts in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        seq = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append((c, len(seq) == d))
    nodes = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = ",".join(str(c) for c, end in sorted(convs) if end)
        nodes.append((
            min(convs)[0], len(path), min(members[path[:-1]])[0] if path else None, len(convs),
            sum(len(p) == len(path) + 1 for p in below),
            sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(nodes, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in turn_trie.prefix_trie(df).select(COLUMNS).collect()), key=str)


def made(seed, convs):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.randint(1, 8)):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "bot", None]), rng.choice(["a", "bé", "", None])))
    return rows


@pytest.mark.parametrize("shard", [200_000, 15])
def test_against_prefixes(spark, monkeypatch, shard):
    """Whole, and cut into many ranges with boundary nodes."""
    monkeypatch.setattr(turn_trie, "SHARD_TURNS", shard)
    rows = made(1, [*range(0, 60), *range(100, 120), 205, -3, -100, -101])
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(4)]  # a group of copies
    rows += [(None, 1, "user", "lost"), (401, None, None, None)]
    rows += [(0, 0, "user", "a")] * 2  # repeated rows
    assert found(spark, rows) == brute(rows)


def test_long_conversations_and_texts(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "SHARD_TURNS", 100)
    rows = [(c, t, "user", "x" * (100_000 if t == 299 else 1)) for c in (10, 11) for t in range(300)]
    assert found(spark, rows) == brute(rows)


def test_no_conversations(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "lost")]) == []


def test_conversation_without_turns_left(spark):
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 5)
    assert found(spark, [(c, 0, "user", "gone")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_medians_balance_the_tree():
    tree = turn_trie.TernaryTree()
    for i in turn_trie.median_order(1023):
        tree.child(0, i, 1)

    def height(n):
        return 0 if n < 0 else 1 + max(height(tree.lo[n]), height(tree.hi[n]))

    assert height(tree.eq[0]) == 10 and len(tree.key) == 1024
