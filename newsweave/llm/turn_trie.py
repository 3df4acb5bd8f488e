"""The prefix trie of conversations, from ternary search trees over range shards.

Turns become numbers, so a conversation is a list of numbers.  The distinct lists are sorted
and cut into ranges.  A task builds a ternary search tree of its range, inserting medians
first, which balances it, and walks the nodes from the last to the first, without
recursion, adding members, leaves and savings to their parents.  Only prefixes of the
first and the last list of a range can go on in another one; these boundary nodes carry what
the rest of the range gave them and are merged in a second, small tree.

Null role or text counts as empty; rows without ``conv_id`` belong to no conversation and
are left out.  Turns are ordered by ``turn``, null first, equal ones by the MD5 of role and
text; repeated rows are repeated turns.  An empty table has no nodes, not even the root.

What a task holds: the turn numbers of one conversation, a range of about ``SHARD_TURNS``
turns, or the boundary nodes, at most two conversations a range.  Digests of members are
streamed in order, each by one task that holds one id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm.numbering import numbered
from newsweave.llm.shared import bounded_batches, written

# Rebuilding: conversations in blocks of 100 share up to 5 first turns of the block's first.
BLOCK, MOST_SHARED = 100, 5
# Turns of a range, about.
SHARD_TURNS = 200_000
# A turn is heavy with more than one in so many rows; there are fewer heavy turns than that.
HEAVY = 1_000
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_key(role: str = "role", text: str = "text"):
    """128 bits that tell turns apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def encoded(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, id, chars``: each turn as a dense number, in the order of its key.

    Heavy turns are looked up in a broadcast table of bounded size, the others by a join.
    """
    turns = written(
        conversations.where(F.col("conv_id").isNotNull()).select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            turn_key().alias("key"),
            F.length(F.coalesce("text", F.lit(""))).alias("chars"),
        ),
        "turns",
    )
    known = turns.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    known = numbered(known, [F.col("key")], "id", "turn-ids")
    heavy = known.where(F.col("n") > turns.count() / HEAVY).select("key", F.col("id").alias("heavy"))
    marked = turns.join(F.broadcast(heavy), "key", "left")
    columns = ["conv_id", "turn", "id", "chars"]
    rest = marked.where("heavy is null").join(known.select("key", "id"), "key").select(columns)
    return marked.where("heavy is not null").withColumn("id", F.col("heavy")).select(columns).unionByName(rest)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, seq``: the first turns of the block's first conversation, then its own."""
    own = encoded(conversations).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "id", "chars"))).alias("turns")
    )
    own = written(own.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"], t["chars"])).alias("own")), "own")
    first = own.where(F.col("conv_id") % BLOCK == 0).select(
        F.col("conv_id").alias("first"), F.slice("own", 1, MOST_SHARED).alias("head")
    )
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), shared), F.slice("own", 1, 0))
    rest = F.slice("own", shared + 1, F.size("own"))
    return own.join(first, F.col("conv_id") - F.col("conv_id") % BLOCK == F.col("first"), "left").select(
        "conv_id", F.concat(head, rest).alias("seq")
    )


# -- members of equal lists ----------------------------------------------------------


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, least id and digest of each key's ids, which come sorted."""
    key, digest, out = None, None, []

    def closed():
        out.append((key, n, least, digest.hexdigest()))

    for batch in batches:
        for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if key is not None:
                    closed()
                key, n, least, digest = k, 0, conv, hashlib.sha256()
            digest.update(b",%d" % conv if n else b"%d" % conv)
            n += 1
        if out:
            yield _rows(out, _DIGESTS)
            out.clear()
    if key is not None:
        closed()
        yield _rows(out, _DIGESTS)


_DIGESTS = pa.schema({"key": pa.string(), "n": pa.int64(), "least": pa.int64(), "ends": pa.string()})


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def distinct_lists(conversations: DataFrame) -> DataFrame:
    """``seq, n, least, ends``: each distinct list with what is known of its members."""
    key = F.md5(F.array_join(F.transform("seq", lambda t: t["id"].cast("string")), ","))
    lists = written(rebuilt(conversations).withColumn("key", key), "lists")
    ends = (
        lists.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
        .mapInArrow(_digests, "key string, n long, least long, ends string")
    )
    return lists.groupBy("key").agg(F.first("seq").alias("seq")).join(ends, "key").drop("key")


# -- trees ---------------------------------------------------------------------------


class TernaryTree:
    """Trie nodes as rows of lists; the children of a node are a binary tree over their keys.

    Node 0 is the root.  ``eq[n]`` is the top of the tree of n's children, ``lo`` and ``hi``
    the siblings with smaller and larger keys, ``up`` the parent.  A parent is always made
    before its children.
    """

    def __init__(self):
        self.key, self.lo, self.eq, self.hi, self.up = [None], [-1], [-1], [-1], [-1]
        self.chars, self.depth, self.members, self.least = [0], [0], [0], [None]
        self.children, self.leaves, self.saved, self.ends = [0], [0], [0], [NOTHING]

    def child(self, at: int, key: int, chars: int) -> int:
        """The child of ``at`` with this key, made if there is none."""
        link, place, n = self.eq, at, self.eq[at]
        while n >= 0 and self.key[n] != key:
            link, place = (self.lo if key < self.key[n] else self.hi), n
            n = link[n]
        if n < 0:
            n = link[place] = len(self.key)
            for column, value in (
                (self.key, key), (self.lo, -1), (self.eq, -1), (self.hi, -1), (self.up, at), (self.chars, chars),
                (self.depth, self.depth[at] + 1), (self.members, 0), (self.least, None), (self.children, 0),
                (self.leaves, 0), (self.saved, 0), (self.ends, NOTHING),
            ):
                column.append(value)
        return n

    def add(self, at: int, members: int, least: int | None, ends: str) -> None:
        """Members that end at a node."""
        self.members[at] += members
        if least is not None and (self.least[at] is None or least < self.least[at]):
            self.least[at] = least
        if ends != NOTHING:
            self.ends[at] = ends

    def accumulate(self, apart: set[int]) -> None:
        """Pass members, leaves and savings up, children before parents.

        Nodes in ``apart``, an upper part of the tree, keep what their other children gave.
        """
        for n in range(len(self.key) - 1, -1, -1):
            if n in apart:
                continue
            if not self.children[n]:
                self.leaves[n] = 1
            self.saved[n] += (self.members[n] - 1) * self.chars[n] if n else 0
            if n:
                p = self.up[n]
                self.children[p] += 1
                self.leaves[p] += self.leaves[n]
                self.saved[p] += self.saved[n]
                self.members[p] += self.members[n]
                if self.least[p] is None or self.least[n] < self.least[p]:
                    self.least[p] = self.least[n]


def median_order(n: int) -> Iterator[int]:
    """0 to n-1, the middle before both halves."""
    todo = [(0, n)]
    while todo:
        start, end = todo.pop()
        if start < end:
            middle = (start + end) // 2
            yield middle
            todo += [(middle + 1, end), (start, middle)]


_NODE = pa.schema(
    [("shard", pa.int32()), ("place", pa.int32()), ("up", pa.int32()), ("key", pa.int64()), ("chars", pa.int64()),
     ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
     ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
)
_NODE_DDL = (
    "shard int, place int, up int, key long, chars long, depth long, conv_id long, parent_conv_id long, n_convs long,"
    " n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
_STEP = 10_000


def _emitted(tree: TernaryTree, shard: int, boundary: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """One row per node; ``place`` numbers boundary nodes, ``up`` is the place of a boundary parent."""
    rows = []
    for n in range(len(tree.key)):
        p = tree.up[n]
        parent = tree.least[p] if n and p not in boundary else None
        rows.append((
            shard, boundary.get(n, -1), boundary.get(p, -1), tree.key[n], tree.chars[n], tree.depth[n], tree.least[n], parent,
            tree.members[n], tree.children[n], tree.leaves[n], tree.saved[n], tree.ends[n],
        ))
        if len(rows) == _STEP:
            yield _rows(rows, _NODE)
            rows = []
    yield _rows(rows, _NODE)


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one range of lists, which come sorted."""
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    table = table.combine_chunks()
    seq = table.column("seq").chunk(0)
    offsets, flat = seq.offsets.to_pylist(), seq.values
    keys, chars = (flat.field(i).to_pylist() for i in (0, 1))
    n, least, ends = (table.column(c).to_pylist() for c in ("n", "least", "ends"))
    tree = TernaryTree()

    def walk(i: int) -> Iterator[int]:
        at = 0
        for j in range(offsets[i], offsets[i + 1]):
            at = tree.child(at, keys[j], chars[j])
            yield at

    for i in median_order(len(n)):
        at = 0
        for at in walk(i):
            pass
        tree.add(at, n[i], least[i], ends[i])
    edge = sorted({0, *walk(0), *walk(len(n) - 1)})
    boundary = {node: place for place, node in enumerate(edge)}
    tree.accumulate(set(edge))
    yield from _emitted(tree, TaskContext.get().partitionId(), boundary)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boundary nodes of all shards as one tree, and for each of them the merged node's least id.

    Parents come before children.  Rows with a ``place`` say what its ``conv_id`` is in the end.
    """
    tree, met, shard = TernaryTree(), [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != shard:
                shard, here = row["shard"], {}
            at = tree.child(here[row["up"]], row["key"], row["chars"]) if row["up"] >= 0 else 0
            here[row["place"]] = at
            met.append((shard, row["place"], at))
            tree.add(at, row["n_convs"], row["conv_id"], row["ends_sha256"])
            tree.children[at] += row["n_children"]
            tree.leaves[at] += row["n_leaves"]
            tree.saved[at] += row["saved_tokens"]
    if not met:
        return
    tree.accumulate(set())
    yield from _emitted(tree, -1, {})
    for start in range(0, len(met), _STEP):
        part = met[start : start + _STEP]
        blank = [None] * len(part)
        columns = [[s for s, _, _ in part], [p for _, p, _ in part], *[blank] * 4, [tree.least[at] for _, _, at in part], *[blank] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _NODE.types)], schema=_NODE)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations, with the root.

    ``conv_id`` is the smallest member and tells, with ``depth``, nodes apart.
    """
    bounded_batches(conversations.sparkSession)
    lists = written(distinct_lists(conversations), "distinct-lists")
    turns = lists.agg(F.sum(F.size("seq") + 1)).first()[0] or 0
    shards = -(-turns // SHARD_TURNS) or 1
    nodes = written(
        lists.repartitionByRange(shards, "seq").sortWithinPartitions("seq").mapInArrow(_shard, _NODE_DDL), "nodes"
    )
    edges = nodes.where("place >= 0").repartition(1).sortWithinPartitions("shard", "place")
    merged = written(edges.mapInArrow(_merged, _NODE_DDL), "boundary")
    final = merged.where("shard < 0")
    links = merged.where("shard >= 0").select("shard", F.col("place").alias("up"), F.col("conv_id").alias("met"))
    whole = nodes.where("place < 0").join(links, ["shard", "up"], "left")
    whole = whole.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "met"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return whole.select(columns).unionByName(final.select(columns))
