"""Whitening against a plain eigensolver over all distinct vectors."""

import math
import os

import numpy as np
import pytest

from newsweave.llm import whitening
from newsweave.llm.queries import op13_whitening
from workload.check import ROOT

SF_DIR = f"{ROOT}/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, `row` string"


def brute(rows, components=4):
    """(vec_id, component) -> figures, by numpy on the driver."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(np.float32(c).astype(float) * 256) for c in v] for _, v in good], dtype=object)
    points = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(points), points.sum(axis=0)
    mean = np.array([float(s) / n for s in sums])
    y = points.astype(float) - mean
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for (i, _), row in zip(good, x):
        deviation = int(sum((n * a - s) ** 2 for a, s in zip(row, sums)))
        for k in range(min(components, len(mean))):
            w = (row.astype(float) - mean) @ vectors[:, k] / np.sqrt(values[k])
            out.append((i, k + 1, n, deviation, w, values[k] / np.trace(cov)))
    return out


def compare(found, expected):
    found = sorted(found, key=lambda r: (r[0], r[1], abs(r[4])))
    expected = sorted(expected, key=lambda r: (r[0], r[1], abs(r[4])))
    assert [r[:4] for r in found] == [r[:4] for r in expected]
    signs = {}
    for f, e in zip(found, expected):
        if abs(e[4]) > 1e-6:
            signs.setdefault(f[1], np.sign(f[4] * e[4]))
        assert f[4] * signs.get(f[1], 1) == pytest.approx(e[4], abs=1e-8)
        assert f[5] == pytest.approx(e[5], rel=1e-9)


def rows_of(df):
    return [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in df.collect()]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_against_numpy(spark):
    found = op13_whitening(spark, SF_DIR)
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    compare(rows_of(found), brute([(r.vec_id, r.embedding) for r in table]))
    assert {r.identity_error < 1e-9 for r in found.select("identity_error").distinct().collect()} == {True}


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(50)]
    rows += [(7, rows[7][1]), (None, rows[8][1])]  # repeated rows, a null id
    odd = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 2.0]), (93, [float("inf"), 0.0, 0.0]),
           (94, []), (95, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], SCHEMA)
    out = whitening.component_rows(df, whitening.fit(df))
    found = [(r.row.vec_id if r.row.vec_id is not None else -1, r.component, r.n, r.deviation, r.whitened, r.explained)
             for r in out.collect()]
    compare(found, brute([(-1 if i is None else i, v) for i, v in rows]))
    assert {r.row.row for r in out.collect()} == {"x"}


def test_no_rows_and_no_variance(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.component_rows(empty, whitening.fit(empty)).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0], 1, ""), (2, [1.0, 2.0], 1, "")], SCHEMA)
    rows = whitening.component_rows(same, whitening.fit(same)).collect()
    assert [(r.row.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows] == [
        (v, c, 1, 0, None, None, None) for v in (1, 2) for c in (1, 2)]
    line = spark.createDataFrame([(i, [float(i), 1.0], 1, "") for i in range(5)], SCHEMA)
    rows = whitening.component_rows(line, whitening.fit(line)).orderBy("row.vec_id", "component").collect()
    assert [abs(round(r.whitened, 6)) if r.whitened is not None else None for r in rows[:2]] == [round(2 / math.sqrt(2), 6), None]
    assert [r.explained for r in rows[:2]] == [1.0, pytest.approx(0, abs=1e-15)]


def test_deviation_beyond_a_long_is_null(spark):
    big = spark.createDataFrame([(1, [1e30, 0.0], 1, ""), (2, [0.0, 0.5], 1, "")], SCHEMA)
    assert {r.deviation for r in whitening.component_rows(big, whitening.fit(big)).collect()} == {None}


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [1, 1 + 1e-9, 1 + 2e-9, 0.5, 0.1], [1, 1, 1, 0.5, 0.5], [1, 1 + 1e-13, 1 + 3e-6, 1e-8, 1e-12], [0, 0, 0, 0, 0],
])
def test_eigenpairs(values):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(5, 5)))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.eigenpairs(a)
    assert np.allclose(found, np.sort(values)[::-1], atol=4e-15)
    assert np.abs(vectors.T @ vectors - np.eye(5)).max() < 4e-16
    assert np.abs(vectors.T @ a @ vectors - np.diag(found)).max() < 2e-15
