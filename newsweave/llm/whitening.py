"""Whitening of embeddings along principal components, refined in mixed precision.

The covariance is summed by the executors over the distinct vectors, in whole steps of
1/256.  The driver sees one matrix of dimension by dimension: its eigenvectors are found in
float32 and corrected by the iteration of Ogita and Aishima, which needs matrix products
alone, in the longest float of the machine.  Eigenvalues too close to be told apart by it
form clusters; each cluster is solved anew inside its own subspace, shifted to its middle.

Rows whose vector is null, or holds null or non-finite entries, are left out; so are those
whose length isn't the most frequent one (the longer of equally frequent ones).  Repeated
rows give repeated results, empty tables none.  A component without variance has no
direction: its ``whitened`` is null.  A single distinct vector has no variance at all, and
``explained`` and ``identity_error`` are null then.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.llm.shared import bounded_batches, written

STEPS = 256
COMPONENTS = 4
# Share of the trace below which an eigenvalue counts as none.
NO_VARIANCE = 1e-13
# Eigenvalues this close, of a matrix whose largest entry is 1, have no vectors of their own.
SAME = 1e-14
ROUNDS, SWEEPS = 8, 12
LONG_MAX = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """What rows are projected with; its size depends on the dimension alone."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # one column a component
    trace: float
    identity_error: float | None = None

    @property
    def live(self) -> int:
        """Components that have variance."""
        return int((self.values > NO_VARIANCE * self.trace).sum())

    def projection(self) -> np.ndarray:
        return self.vectors[:, : self.live] / np.sqrt(self.values[: self.live])

    def mean(self) -> np.ndarray:
        return np.array([float(s) / self.n for s in self.sums])


# -- eigenvectors --------------------------------------------------------------------


def _sweep(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One step of the iteration: better vectors, eigenvalues, the least gap it can tell, its change."""
    r = np.eye(x.shape[1], dtype=x.dtype) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    told = 2 * float(np.sqrt((off * off).sum()) + np.sqrt((a * a).sum()) * np.sqrt((r * r).sum()))
    told = max(told, SAME)
    gaps = values[None, :] - values[:, None]
    apart = np.abs(gaps) > told
    change = np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1), r / 2)
    return x + x @ change, values, told, float(np.abs(change).max(initial=0))


def _refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sweeps until they change nothing more."""
    last = np.inf
    for _ in range(SWEEPS):
        x, values, told, change = _sweep(a, x)
        if change == 0 or (change > last / 2 and change < 1e-12):
            break
        last = change
    return x, values, told


def _clusters(values: np.ndarray, told: float) -> Iterator[np.ndarray]:
    """Places of eigenvalues that follow each other within ``told``."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > told) + 1
    return (group for group in np.split(order, cuts) if len(group) > 1)


def eigenpairs(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, to double precision."""
    a = np.asarray(matrix, np.longdouble)
    scale = np.abs(a).max(initial=0)
    if scale == 0:
        return np.zeros(len(a)), np.eye(len(a))
    a = (a + a.T) / (2 * scale)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    for _ in range(ROUNDS):
        x, values, told = _refined(a, x)
        solved = False
        for group in _clusters(values, max(told, 1e-7)):
            middle = values[group].mean()
            basis = x[:, group]
            inside = basis.T @ (a @ basis - middle * basis)
            size = np.abs(inside).max()
            off = np.abs(inside - np.diag(np.diag(inside))).max()
            if off > 1e-15 * size and size > 1e-18:
                x[:, group] = basis @ np.linalg.eigh((inside / size).astype(np.float64))[1].astype(np.longdouble)
                solved = True
        if not solved:
            break
    for _ in range(3):  # back to right angles, by products alone
        x = x @ (3 * np.eye(x.shape[1], dtype=x.dtype) - x.T @ x) / 2
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order] * scale
    signs = np.sign(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])])
    return values.astype(np.float64), (x * signs).astype(np.float64)


# -- sums over the fit list ----------------------------------------------------------


def whole_steps(embedding: Column) -> Column:
    """The vector in whole steps of 1/256, rounded down."""
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * STEPS) + F.lit(0).cast("long"))


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _exact_sum(x: np.ndarray) -> np.ndarray:
    """Sums of columns as Python ints."""
    return sum((part.astype(object).sum(axis=0) if np.abs(part).max(initial=0) > 2**31 else part.sum(axis=0).astype(object)
                for part in np.array_split(x, max(1, len(x) // 2**20))), np.zeros(x.shape[1], object))


def _sums(points: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of points and exact sums of their dimensions; the driver gets one row for each."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            n, total = n + len(x), total + _exact_sum(x)
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dim + 1), pa.int32()), pa.array([str(int(v)) for v in (n, *total)]).cast(kind)], ["i", "v"]
        )

    rows = points.mapInArrow(partial, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()
    found = {row["i"]: int(row["v"]) for row in rows}
    return found.get(0, 0), [found.get(i + 1, 0) for i in range(dim)]


def _products(points: DataFrame, model: Whitening, matrix: np.ndarray) -> np.ndarray:
    """Mean of the outer products of the centred points, each first put through ``matrix``.

    A partition gives one upper triangle, whatever its rows; triangles are added by entry.
    """
    mean, dim, out = model.mean(), len(model.sums), matrix.shape[1]
    upper = np.triu_indices(out)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((out, out))
        for batch in batches:
            y = (_matrix(batch.column(0), dim) - mean) @ matrix
            total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], ["i", "j", "v"]
        )

    rows = points.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    result = np.zeros((out, out))
    for row in rows:
        result[row["i"], row["j"]] = result[row["j"], row["i"]] = row["v"] / model.n
    return result


def fit(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Covariance of the distinct vectors and its eigenvectors; None if no row has a usable vector."""
    bounded_batches(embeddings.sparkSession)
    vectors = embeddings.where(usable(F.col(column))).select(whole_steps(F.col(column)).alias("x"))
    size = vectors.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if size is None or size["dim"] == 0:
        return None
    points = written(vectors.where(F.size("x") == size["dim"]).distinct(), "vectors")
    n, sums = _sums(points, size["dim"])
    blank = np.zeros((0, 0))
    start = Whitening(n, sums, np.zeros(0), blank, 0.0)
    covariance = _products(points, start, np.eye(size["dim"]))
    values, basis = eigenpairs(covariance)
    model = Whitening(n, sums, values[:components], basis[:, :components], float(np.trace(covariance)))
    if not model.live:
        return model
    error = np.abs(_products(points, model, model.projection()) - np.eye(model.live)).max()
    return Whitening(n, sums, model.values, model.vectors, model.trace, float(error))


# -- rows ----------------------------------------------------------------------------


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n*x - S)^2, exact; None where a long doesn't hold one."""
    reach = n * int(np.abs(x.astype(object)).max(initial=0)) + max(map(abs, sums), default=0)
    if reach < 2**31 and reach * reach * len(sums) < LONG_MAX:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    return [int(v) if v <= LONG_MAX else None for v in (d * d).sum(axis=1)]


def whitened(embeddings: DataFrame, model: Whitening | None, column: str = "embedding") -> DataFrame:
    """All columns of each usable row in a struct ``row``, with ``deviation`` and the array ``whitened``."""
    rows = embeddings.where(usable(F.col(column)))
    if model is None:
        kinds = {"deviation": "long", "whitened": "array<double>"}
        return rows.where(F.lit(False)).select(F.struct("*").alias("row"), *(F.lit(None).cast(k).alias(c) for c, k in kinds.items()))
    n, sums, mean, dim, lost = model.n, model.sums, model.mean(), len(model.sums), len(model.values) - model.live
    projection = model.projection()

    @F.pandas_udf("deviation long, whitened array<double>")
    def project(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, dim), np.int64)
        y = (x - mean) @ projection
        return pd.DataFrame({
            "deviation": pd.array(_deviations(x, n, sums), "Int64"),
            "whitened": [[*row, *[None] * lost] for row in y.tolist()],
        })

    steps = whole_steps(F.col(column))
    return (
        rows.where(F.size(column) == dim)
        .select(F.struct("*").alias("row"), project(steps).alias("p"))
        .select("row", "p.deviation", "p.whitened")
    )


def component_rows(embeddings: DataFrame, model: Whitening | None, column: str = "embedding") -> DataFrame:
    """One row per usable row and component, with the figures of the model beside it."""
    one = F.lit(None).cast("double")
    shares = [one] * COMPONENTS
    if model is not None:
        shares = [F.lit(float(v) / model.trace) if model.trace > 0 else one for v in model.values]
    error = one if model is None or model.identity_error is None else F.lit(model.identity_error)
    return whitened(embeddings, model, column).select(
        "row",
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        F.posexplode("whitened").alias("place", "whitened"),
        F.array(*shares).alias("shares"),
        error.alias("identity_error"),
    ).select(
        "row",
        (F.col("place") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get("shares", F.col("place")).alias("explained"),
        "identity_error",
    )
