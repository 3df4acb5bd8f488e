"""Near-duplicate vectors by dual traversal of cover trees.

Vectors of one label are cut into compact blocks.  Each block gets a cover tree: nested
levels of centres whose radii halve, every point within its centre's radius.  Two trees are
walked down together, and a pair of nodes is dropped when the distance of its centres
exceeds both covering radii and the linking distance.  What remains at the leaves is
compared exactly, so the links are those of comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm.components import components
from newsweave.llm.shared import bounded_batches, written

THRESHOLD = 0.98
# Vectors of a block, about; a task holds two blocks.
BLOCK = 2048
# Blocks of the labels with the most vectors are made compact around pivots: at most so
# many labels, sampled vectors and pivots each.  The pivots are broadcast, 2 MB at most for
# vectors of 64 numbers.  They only steer which vectors share a block.
PIVOT_LABELS, PIVOT_SAMPLE, PIVOTS = 256, 64, 16
# Distances are compared with this much tolerance while pruning.
SLACK = 1e-7


def unit(values: list | None) -> np.ndarray | None:
    """The vector scaled to length 1; None where it has no direction."""
    if values is None or len(values) == 0 or any(x is None for x in values):
        return None
    v = np.asarray(values, np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


class CoverTree:
    """order: the points with the root first; level: where a point becomes a centre; parent: its centre
    one level up; reach[k]: covering radius of each centre's node at level k."""

    def __init__(self, x: np.ndarray, threshold: float = THRESHOLD):
        near = np.sqrt(max(0.0, 2.0 - 2.0 * threshold))
        root = int(np.argmax(x @ x.mean(axis=0)))
        self.order = np.concatenate(([root], np.delete(np.arange(len(x)), root)))
        x = x[self.order]
        d = distances(x, x)
        n = len(x)
        self.level, self.parent = np.full(n, -1), np.zeros(n, np.int64)
        self.level[0] = 0
        centres, radius, k = np.zeros(1, np.int64), 2.0, 0
        while radius > max(near / 2, 1e-3):
            radius, k = radius / 2, k + 1
            covered = (d[centres] <= radius).any(axis=0)
            fresh = []
            for i in np.flatnonzero(~covered):
                if not covered[i]:
                    fresh.append(i)
                    covered |= d[i] <= radius
            self._hang(np.array(fresh, np.int64), centres, d, k)
            centres = np.concatenate((centres, np.array(fresh, np.int64)))
        self._hang(np.flatnonzero(self.level < 0), centres, d, k + 1)
        self.depth = k + 2
        self.reach = np.zeros((self.depth, n))
        owner = np.arange(n)
        for level in range(k, -1, -1):
            owner = np.where(self.level[owner] <= level, owner, self.parent[owner])
            np.maximum.at(self.reach[level], owner, d[owner, np.arange(n)])

    def _hang(self, fresh: np.ndarray, centres: np.ndarray, d: np.ndarray, level: int) -> None:
        if len(fresh):
            self.level[fresh] = level
            self.parent[fresh] = centres[np.argmin(d[np.ix_(fresh, centres)], axis=1)]


def _children(level: np.ndarray, parent: np.ndarray, k: int) -> dict[int, np.ndarray]:
    """The children at level k of each centre of the level above, itself included."""
    fresh = np.flatnonzero(level == k)
    by = fresh[np.argsort(parent[fresh], kind="stable")]
    owners, starts = np.unique(parent[by], return_index=True)
    groups = dict(zip(owners.tolist(), np.split(by, starts[1:]), strict=True)) if len(by) else {}
    return {int(c): np.concatenate(([c], groups.get(int(c), by[:0]))) for c in np.flatnonzero((level >= 0) & (level < k))}


def linked_pairs(a: tuple, b: tuple | None, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of points with cosine >= threshold; a and b: (vectors, level, parent, reach).

    Without b, the pairs inside a, each once.
    """
    near = np.sqrt(max(0.0, 2.0 - 2.0 * threshold))
    same = b is None
    x, level_a, parent_a, reach_a = a
    y, level_b, parent_b, reach_b = a if same else b
    depth = len(reach_a)
    pairs: dict[int, np.ndarray] = {0: np.zeros(1, np.int64)}
    for k in range(1, depth):
        below_a = _children(level_a, parent_a, k)
        below_b = below_a if same else _children(level_b, parent_b, k)
        leaf = k == depth - 1
        kept: dict[int, list[np.ndarray]] = {}
        for p, partners in pairs.items():
            rows = below_a[p]
            columns = np.concatenate([below_b[q] for q in partners.tolist()])
            cosine = x[rows] @ y[columns].T
            if leaf:
                keep = cosine >= threshold - 1e-12
            else:
                most = reach_a[k][rows][:, None] + reach_b[k][columns][None, :] + near + SLACK
                keep = 2.0 - 2.0 * cosine <= most * most
            if same and p in partners:
                # Inside one node each pair of children counts once, a child with itself only above the leaves.
                own = np.isin(columns, rows)
                order = rows[:, None] < columns[None, :] if leaf else rows[:, None] <= columns[None, :]
                keep &= order | ~own[None, :]
            i, j = np.nonzero(keep)
            if leaf and len(i):
                close = np.abs(cosine[i, j] - threshold) <= 1e-12
                exact = np.array([float(np.dot(x[r], y[c])) >= threshold for r, c in zip(rows[i[close]], columns[j[close]], strict=True)], bool)
                fine = np.ones(len(i), bool)
                fine[close] = exact
                i, j = i[fine], j[fine]
            for r in np.unique(i).tolist():
                kept.setdefault(int(rows[r]), []).append(columns[j[i == r]] if len(i) < 4096 else columns[j[np.searchsorted(i, r) : np.searchsorted(i, r, "right")]])
        pairs = {p: np.concatenate(q) for p, q in kept.items()}
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([np.full(len(q), p) for p, q in pairs.items()]), np.concatenate(list(pairs.values()))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [unit(v) for v in batch.column("embedding").to_pylist()]
        data = [None if u is None else u.tobytes() for u in units]
        digests = [None if x is None else xxhash.xxh3_128_digest(x) for x in data]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array([None if u is None else len(u) for u in units], pa.int32()),
             pa.array(digests, pa.binary()), pa.array(data, pa.binary())],
            ["vec_id", "label", "dim", "digest", "vector"],
        )


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column)).reshape(len(column), -1)


def _with_cells(points: DataFrame) -> DataFrame:
    """points with the cell of the nearest pivot of their label; one cell for labels without pivots."""
    counts = points.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    largest = counts.orderBy(F.desc("n"), "label", "dim").limit(PIVOT_LABELS)
    every = F.ceil(F.col("n") / PIVOT_SAMPLE)
    sample = (
        points.join(F.broadcast(largest), ["label", "dim"])
        .where(F.pmod("node", every) == 0)
        .select("label", "dim", "node", "vector")
    )
    pivots: dict[tuple, np.ndarray] = {}
    for row in sorted(sample.collect(), key=lambda r: r["node"]):
        pivots.setdefault((row["label"], row["dim"]), []).append(np.frombuffer(row["vector"]))
    rows_of = {(r["label"], r["dim"]): r["n"] for r in largest.collect()}
    for key, vectors in pivots.items():
        x = np.stack(vectors[: 2 * PIVOT_SAMPLE])
        chosen, least = [0], distances(x, x[:1])[:, 0]
        # As many cells as the label has blocks.
        while len(chosen) < min(PIVOTS, len(x), -(-rows_of[key] // BLOCK)):
            chosen.append(int(np.argmax(least)))
            least = np.minimum(least, distances(x, x[chosen[-1:]])[:, 0])
        pivots[key] = x[chosen]
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cell = np.zeros(len(frame), np.int32)
            for key, at in frame.groupby(["label", "dim"]).indices.items():
                if key in shared.value:
                    cell[at] = np.argmax(_matrix(frame["vector"].iloc[at]) @ shared.value[key].T, axis=1)
            yield frame.assign(cell=cell)

    return points.mapInPandas(rows, ", ".join(f"{n} {t}" for n, t in points.dtypes) + ", cell int")


def _planted(frame: pd.DataFrame) -> pd.DataFrame:
    x = _matrix(frame["vector"])
    tree = CoverTree(x)
    frame = frame.iloc[tree.order].reset_index(drop=True)
    return pd.DataFrame({
        "block": frame["block"], "label": frame["label"], "dim": frame["dim"], "node": frame["node"], "copies": frame["copies"],
        "vector": frame["vector"], "place": np.arange(len(frame), dtype=np.int32), "level": tree.level.astype(np.int32),
        "parent": tree.parent.astype(np.int32), "reach": list(tree.reach.T),
    })


def _near_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    near = np.sqrt(2.0 - 2.0 * THRESHOLD)
    for frame in frames:
        for _, part in frame.groupby("dim"):
            a, b = _matrix(part["vector_a"]), _matrix(part["vector_b"])
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a * b).sum(axis=1)))
            yield part[d <= part["reach_a"] + part["reach_b"] + near + SLACK][["a", "b"]]


def _links_of(frame: pd.DataFrame) -> pd.DataFrame:
    sides = []
    for _, side in frame.groupby("side"):
        side = side.sort_values("place")
        sides.append((side, (_matrix(side["vector"]), side["level"].to_numpy(), side["parent"].to_numpy(), np.stack(side["reach"]).T)))
    i, j = linked_pairs(sides[0][1], sides[1][1] if len(sides) > 1 else None)
    points = pd.concat([s for s, _ in sides], ignore_index=True)
    if len(sides) > 1:
        j = j + len(sides[0][0])
    copies = points["copies"].to_numpy()
    links = np.zeros(len(points), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    group = np.arange(len(points))
    while len(i):
        least = np.minimum(group[i], group[j])
        before = group.copy()
        np.minimum.at(group, i, least)
        np.minimum.at(group, j, least)
        group = group[group]
        if (group == before).all():
            break
    nodes = points["node"].to_numpy()
    has = links > 0
    return pd.DataFrame({"node": nodes[has], "links": links[has], "other": nodes[group[has]]})


def linked_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of embeddings.

    Rows are linked whose labels are equal and not null and whose vectors have as many
    numbers and a cosine of 0.98 or more.  Null, empty and zero vectors and those with null or
    non-finite numbers link with nothing.  n_links counts other rows, copies too;
    component_id is the least vec_id that links reach, kept is ``vec_id = component_id`` (a
    row without a vec_id: whether its component has none at all).  Repeated rows count as
    many.  Only vec_id, label and embedding are read.

    Copies are one point with a count.  A task compares two blocks and returns a count and
    one link per point, however many pairs there are.
    """
    bounded_batches(embeddings.sparkSession)
    kinds = dict(embeddings.dtypes)
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>")).mapInArrow(
        _packed, f"vec_id {kinds['vec_id']}, label {kinds['label']}, dim int, digest binary, vector binary"
    )
    node = F.when(F.col("label").isNotNull() & F.col("digest").isNotNull(), F.xxhash64("label", "dim", "digest"))
    rows = written(rows.withColumn("node", node), "vectors")
    points = rows.where(F.col("node").isNotNull()).groupBy("label", "dim", "node").agg(
        F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")
    )
    points = written(points, "points")
    cells = written(_with_cells(points), "cells")
    sizes = cells.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n"))
    salt = F.pmod("node", F.ceil(F.col("n") / BLOCK))
    blocks = cells.join(sizes, ["label", "dim", "cell"]).select(
        F.xxhash64("label", "dim", "cell", salt).alias("block"), "label", "dim", "node", "copies", "vector"
    )
    label = kinds["label"]
    trees = written(
        blocks.groupBy("block").applyInPandas(
            _planted,
            f"block long, label {label}, dim int, node long, copies long, vector binary, place int, level int, parent int, reach array<double>",
        ),
        "trees",
    )
    roots = trees.where("place = 0").select("label", "dim", "block", "vector", F.col("reach")[0].alias("reach"))
    one = roots.withColumnsRenamed({"block": "a", "vector": "vector_a", "reach": "reach_a"})
    two = roots.withColumnsRenamed({"block": "b", "vector": "vector_b", "reach": "reach_b"})
    couples = one.join(two, ["label", "dim"]).where("a <= b").drop("label")
    couples = written(couples.mapInPandas(_near_blocks, "a long, b long"), "couples")
    member = ["node", "copies", "vector", "place", "level", "parent", "reach"]
    left = trees.join(couples.select(F.col("a").alias("block"), "a", "b"), "block").select("a", "b", F.lit(0).alias("side"), *member)
    right = trees.join(couples.where("a < b").select(F.col("b").alias("block"), "a", "b"), "block").select("a", "b", F.lit(1).alias("side"), *member)
    found = written(
        left.unionByName(right).groupBy("a", "b").applyInPandas(_links_of, "node long, links long, other long"), "vector-links"
    )
    groups = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = (
        points.select("node", "copies")
        .join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .join(groups.withColumnRenamed("id", "node"), "node", "left")
        .select("node", "copies", "links", F.coalesce("component", "node").alias("component"))
    )
    named = rows.select("node", "vec_id").groupBy("node").agg(F.min("vec_id").alias("vec_id"))
    placed = written(placed.join(named, "node"), "placed-vectors")
    least = placed.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    placed = written(placed.join(least, "component").select(F.col("node").alias("of"), "copies", "links", "component_id"), "vector-components")
    result = rows.select("vec_id", "node").join(placed, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    others = F.when(F.col("node").isNull(), F.lit(0)).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    return result.select(
        "vec_id", others.cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
