"""Cover trees and vector links against all pairs."""

import numpy as np
import pandas as pd
import pytest

from newsweave.llm import cover_tree
from newsweave.llm.cover_tree import CoverTree, distances, linked_pairs, linked_vectors

SCHEMA = "vec_id long, label int, embedding array<double>, node string"


def brute(rows):
    """{position: (links, component)} by comparing all pairs."""
    units = []
    for _, label, v, _ in rows:
        good = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v) / np.linalg.norm(v) if good else None)
    links = [[] for _ in rows]
    for i, a in enumerate(units):
        for j, b in enumerate(units):
            if i != j and a is not None and b is not None and len(a) == len(b) and rows[i][1] == rows[j][1] and a @ b >= 0.98:
                links[i].append(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids, default=None)))
    return sorted(out, key=str)


def cluster_rows(n=400, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=dim) * 0.15
        rows.append((i, int(rng.integers(3)), (v * rng.uniform(0.5, 2)).tolist(), "x"))
    rows += [(n + i, 0, rows[0][2], "copy") for i in range(30)]
    return rows


@pytest.mark.parametrize("block", [2048, 32])
def test_links_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rows = cluster_rows()
    rows += [
        (900, None, [1.0] * 8, ""), (901, 0, None, ""), (902, 0, [0.0] * 8, ""), (903, 0, [float("nan")] + [1.0] * 7, ""),
        (904, 0, [None] + [1.0] * 7, ""), (905, 0, [], ""), (906, 0, [1.0, 2.0], ""), (None, 0, rows[5][2], ""), (7, 1, rows[7][2], ""), (7, 1, rows[7][2], ""),
    ]
    got = linked_vectors(spark.createDataFrame(rows, SCHEMA)).toPandas()
    ours = sorted(((None if pd.isna(r.vec_id) else int(r.vec_id), r.n_links, None if pd.isna(r.component_id) else int(r.component_id)) for r in got.itertuples()), key=str)
    assert ours == brute(rows)
    assert (got.dropna().kept == (got.dropna().vec_id == got.dropna().component_id)).all()


def test_empty_table(spark):
    assert linked_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("spread", [0.02, 0.2, 2.0])
def test_tree_and_traversal(spread):
    rng = np.random.default_rng(3)
    x = rng.normal(size=6) + rng.normal(size=(300, 6)) * spread
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = CoverTree(x)
    y = x[tree.order]
    d = distances(y, y)
    radius = 2.0
    for level in range(1, tree.depth - 1):
        radius /= 2
        centres = np.flatnonzero(tree.level <= level)
        assert (d[:, centres].min(axis=1) <= radius + 1e-9).all()
        apart = d[np.ix_(centres, centres)] + 9 * np.eye(len(centres))
        assert apart.min() > radius - 1e-9
    parts = [(y, tree.level, tree.parent, tree.reach)]
    i, j = linked_pairs(parts[0], None)
    assert sorted(map(tuple, np.sort(np.stack([i, j], 1), axis=1).tolist())) == sorted(
        (a, b) for a in range(300) for b in range(a + 1, 300) if y[a] @ y[b] >= 0.98
    )
    other = rng.normal(size=6) + rng.normal(size=(50, 6)) * spread
    z = np.concatenate([other / np.linalg.norm(other, axis=1, keepdims=True), x[:20]])
    second = CoverTree(z)
    z = z[second.order]
    i, j = linked_pairs(parts[0], (z, second.level, second.parent, second.reach))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(a, b) for a in range(300) for b in range(70) if y[a] @ z[b] >= 0.98]
