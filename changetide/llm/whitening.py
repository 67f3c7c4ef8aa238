"""Whitening of vectors, by singular values of the centred rows rather than by their covariance.

The fit list is each distinct vector of integers x = floor(64 * c) + 1000000 once. Tasks reduce their
centred rows block by block to a triangle by QR; triangles are stacked and reduced again in a tree, so
only a few of them, each d * d for d dimensions, ever reach the driver. `bidiagonal` takes the last one
apart. No covariance is formed on the way, so small singular values don't lose half of their digits.
A last pass over the fit list measures the covariance of the whitened values.

Rows whose vector is null, holds null or non-finite entries or hasn't the usual number of dimensions are
dropped. Entries beyond ± 2^34 count as that. Repeated rows give repeated rows; a null id stays null.
Components whose eigenvalue is zero to rounding (constant dimensions, fewer vectors than dimensions)
are returned with a null whitened value and explained 0; the identity error leaves them out and is 0 if
none is left. A deviation that no long can hold is null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changetide.llm.bidiagonal import decomposed
from changetide.llm.scratch import stored
from changetide.llm.vectors import finite, floored, matrix

FACTOR, SHIFT, LIMIT = 64, 1_000_000, 2**40
#: Triangles that one task, or the driver, stacks.
FAN_IN = 8
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Centre:
    """n vectors with sums per dimension: differences from their mean, exact ones as multiples of 1/n."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n * x - sum)^2."""
        near = x - self.base
        sizes = (((near.astype(np.float64) + 1) * self.n) ** 2).sum(axis=1)
        out: list = [None] * len(x)
        small = np.flatnonzero(sizes < 2.0**62)
        gap = near[small] * self.n - self.rest
        for i, value in zip(small.tolist(), (gap * gap).sum(axis=1).tolist()):
            out[i] = value
        for i in np.flatnonzero(sizes >= 2.0**62).tolist():
            value = sum((v * self.n - r) ** 2 for v, r in zip(near[i].tolist(), self.rest.tolist()))
            out[i] = value if value < 2**63 else None
        return out


def centre(fit: DataFrame) -> Centre | None:
    """Number and exact sums of the rows of fit (x)."""

    def run(batches):
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                own = matrix(batch.column(0)).sum(axis=0).tolist()  # at most 2^41 times the rows of a batch
                sums = own if sums is None else [a + b for a, b in zip(sums, own)]
                n += batch.num_rows
        if n:
            digits = pa.array([str(s) for s in sums])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums)), digits], names=["dim", "n", "s"])

    parts = fit.mapInArrow(run, "dim int, n long, s string").groupBy("dim")
    sums = parts.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = sorted((r["dim"], r["n"], int(r["s"])) for r in sums)
    return Centre(sums[0][1], [s for _, _, s in sums]) if sums else None


def _triangle(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The triangle of all blocks stacked, one block at a time."""
    triangle = None
    for block in blocks:
        triangle = np.linalg.qr(block if triangle is None else np.vstack([triangle, block]), mode="r")
    if triangle is not None:
        yield pa.RecordBatch.from_arrays([pa.array([triangle.tobytes()], pa.binary())], names=["r"])


def triangle(fit: DataFrame, mean: Centre, d: int) -> np.ndarray:
    """R of the centred rows of fit (x), d * d."""

    def reduced(batches):
        return _triangle(mean.centred(matrix(b.column(0))) for b in batches if b.num_rows)

    def stacked(batches):
        return _triangle(np.frombuffer(r.as_buffer()).reshape(-1, d) for b in batches for r in b.column(0))

    parts = stored(fit.mapInArrow(reduced, "r binary"))
    while (count := parts.count()) > FAN_IN:
        parts = stored(parts.repartition(-(-count // FAN_IN)).mapInArrow(stacked, "r binary"))
    rows = [np.frombuffer(r["r"]).reshape(-1, d) for r in parts.collect()]
    last = np.linalg.qr(np.vstack(rows), mode="r")
    return np.vstack([last, np.zeros((d - len(last), d))])


class Whitening:
    """A fitted whitening: centre, directions as columns over their deviations, and shares."""

    def __init__(self, fit: DataFrame, components: int):
        self.centre = centre(fit)
        if self.centre is None:
            return
        d = len(self.centre.base)
        squares, directions = decomposed(triangle(fit, self.centre, d), components)
        signs = np.sign(directions[np.abs(directions).argmax(axis=0), range(directions.shape[1])]) if directions.size else 1
        self.components = min(components, d)
        self.found = directions.shape[1]
        self.axes = directions * signs / np.sqrt(squares[: self.found] / self.centre.n)
        total = float(squares.sum())
        self.shares = [float(s) / total for s in squares[: self.found]] + [0.0] * (self.components - self.found)

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.axes

    def identity_error(self, fit: DataFrame) -> float:
        """Largest absolute entry of the whitened values' covariance over fit, less the identity."""
        k = self.found
        if not k:
            return 0.0

        def run(batches):
            total = np.zeros((k + 1, k))
            for batch in batches:
                if batch.num_rows:
                    w = self.of(matrix(batch.column(0)))
                    total[:k] += w.T @ w
                    total[k] += w.sum(axis=0)
            places = [pa.array(i.ravel().astype(np.int32)) for i in np.indices(total.shape)]
            yield pa.RecordBatch.from_arrays([*places, pa.array(total.ravel())], names=["i", "j", "s"])

        total = np.zeros((k + 1, k))
        for r in fit.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
            total[r["i"], r["j"]] = r["s"] / self.centre.n
        return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each remaining row of vectors and component: vec_id, component, n, deviation, whitened,
    explained, identity_error."""
    rows = finite(vectors, id_col, vector_col).select(F.col("id").alias("vec_id"), floored("v", FACTOR, SHIFT, LIMIT).alias("x"))
    fit = stored(rows.select("x").distinct())
    model = Whitening(fit, components)
    if model.centre is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    error, k, found = model.identity_error(fit), model.components, model.found

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = matrix(part.column(1))
                m = len(x)
                values = np.zeros((m, k))
                values[:, :found] = model.of(x)
                absent = np.tile(np.arange(k) >= found, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.centre.n)),
                        pa.array(model.centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(values.ravel(), mask=absent),
                        pa.array(np.tile(model.shares, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=[f.split()[0] for f in OUT.split(", ")],
                )

    return rows.mapInArrow(run, OUT)
