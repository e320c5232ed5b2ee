"""Embedding whitening: exact means on a grid of integers, covariances in double-double, eigenvectors of the covariance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stash

#: An entry c becomes floor(SCALE * c) + SHIFT. Vectors with an entry of an absolute value of ``LARGEST`` or more have no place on the grid.
SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 30)
COMPONENTS = 8
#: Partial sums that a task merges at once, rows after which a task passes on its column sums, and products held at once.
FAN_IN, FLUSH_ROWS, HELD = 32, 1 << 20, 1 << 18


@dataclass
class Whitening:
    """What ``fit`` learns: rows, column sums (exact), eigenvalues of the covariance by falling size, eigenvectors as columns, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def whole(self) -> np.ndarray:
        """Which components have an eigenvalue above rounding, and so a whitened value."""
        return self.values > len(self.sums) * np.finfo(float).eps * self.trace


def grid(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and grid values (rows by ``dims``, long) of the vectors that take part: of that length, each entry finite and below ``LARGEST``."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    at = np.flatnonzero(sizes == dims)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    values = flat.reshape(-1, dims) if len(at) == len(sizes) else flat[starts[at][:, None] + np.arange(dims)]
    fits = (np.abs(values) < LARGEST).all(1)  # false for NaN, and so for null
    return at[fits], np.floor(values[fits] * SCALE).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S as long where that is sure to fit, else as Python integers."""
    middle = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    near = x - middle
    if n * (int(np.abs(near).max(initial=0)) + 1) < 1 << 63:
        return near * n - rest
    return near.astype(object) * n - rest.astype(object)


def add(h1: np.ndarray, l1: np.ndarray, h2: np.ndarray, l2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two double-doubles: the error of the high parts' sum is exact, and joins the low parts."""
    s = h1 + h2
    b = s - h1
    low = (h1 - (s - b)) + (h2 - b) + (l1 + l2)
    high = s + low
    return high, low - (high - s)


def total(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of double-doubles over the first axis, pair by pair."""
    while len(high) > 1:
        even = len(high) // 2 * 2
        h, l = add(high[0:even:2], low[0:even:2], high[1:even:2], low[1:even:2])
        high, low = np.concatenate([h, high[even:]]), np.concatenate([l, low[even:]])
    return high[0], low[0]


def halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low 26 bits of doubles, so that products of parts are exact."""
    c = a * 134_217_729.0  # 2 ** 27 + 1
    high = c - (c - a)
    return high, a - high


def outer_sum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over rows of the products of every two columns (upper triangle, row by row), each with the exact error of its rounding."""
    i, j = np.triu_indices(a.shape[1])
    step, parts = max(1, HELD // len(i)), []
    for k in range(0, len(a), step):
        x = a[k : k + step]
        h, l = halves(x)
        p = x[:, i] * x[:, j]
        error = ((h[:, i] * h[:, j] - p) + h[:, i] * l[:, j] + l[:, i] * h[:, j]) + l[:, i] * l[:, j]
        parts.append(total(p, error))
    return total(np.stack([p[0] for p in parts]), np.stack([p[1] for p in parts]))


def products(vectors: DataFrame, embedding: str, dims: int, width: int, turn) -> np.ndarray:
    """Sum over all rows of the outer products of ``turn(x)`` (rows by ``width``) with themselves, as a matrix of doubles.

    Each task keeps one double-double per entry; those of ``FAN_IN`` tasks are added in a task for each row of the matrix, again and again
    until one is left. Only that, of a size that no row count changes, reaches the driver.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            x = grid(batch.column(0), dims)[1]
            if len(x):
                new = outer_sum(turn(x))
                held = new if held is None else add(*held, *new)
        if held is not None:
            ends = np.cumsum(np.arange(width, 0, -1))
            rows = [[part[e - (width - k) : e].tolist() for k, e in enumerate(ends)] for part in held]
            task = np.full(width, TaskContext.get().partitionId(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(np.arange(width)), pa.array(rows[0], pa.list_(pa.float64())), pa.array(rows[1], pa.list_(pa.float64()))], ["task", "i", "high", "low"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("task")
        high, low = total(np.stack(rows["high"].to_list()), np.stack(rows["low"].to_list()))
        return pd.DataFrame({"task": rows["task"].iloc[:1] // FAN_IN, "i": rows["i"].iloc[:1], "high": [high], "low": [low]})

    schema = "task long, i long, high array<double>, low array<double>"
    parts = stash(vectors.select(embedding).mapInArrow(partial, schema))
    most = parts.agg(F.max("task")).first()[0] or 0
    while most > 0:
        parts = parts.groupBy(F.floor(F.col("task") / FAN_IN), "i").applyInPandas(merge, schema)
        most //= FAN_IN
    out = np.zeros((width, width))
    for r in parts.collect():
        out[r.i, r.i :] = np.array(r.high) + np.array(r.low)
    return np.triu(out) + np.triu(out, 1).T


def fit(vectors: DataFrame, embedding: str = "embedding") -> Whitening:
    """Means and the covariance's eigenvectors of all ``vectors`` that take part (see ``whiten``), centred before multiplying, divisor n.

    The covariance is symmetric and of the size of a vector, so the driver solves it: LAPACK brings it to tridiagonal form and divides and
    conquers (dsyevd, behind ``numpy.linalg.eigh``).
    """

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out() -> pa.RecordBatch:
            kept = [(size, n, s.tolist()) for size, (n, s) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.list_(pa.int64()))], ["size", "n", "sums"])

        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(0)), -1).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes > 0]).tolist():
                x = grid(batch.column(0), size)[1]
                if len(x):
                    n, s = held.get(size, (0, 0))
                    held[size] = (n + len(x), s + x.sum(0))
            if sum(n for n, _ in held.values()) >= FLUSH_ROWS:
                yield out()
        if held:
            yield out()

    empty = Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    parts = stash(vectors.select(embedding).mapInArrow(sums_of, "size long, n long, sums array<long>"))
    common = parts.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if common is None:
        return empty
    dims, n = common["size"], common["n"]
    per = parts.where(F.col("size") == dims).select(F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = [int(r.s) for r in sorted(per.collect(), key=lambda r: r.k)]
    cov = products(vectors, embedding, dims, dims, lambda x: centred(x, n, sums).astype(float)) / float(n) ** 3
    values, q = np.linalg.eigh(cov)
    values, q = values[::-1], q[:, ::-1]
    q = q * np.where(q[np.abs(q).argmax(0), np.arange(dims)] < 0, -1.0, 1.0)  # the largest entry of each is positive
    return Whitening(n, sums, values, q, float(np.trace(cov)))


def projected(x: np.ndarray, model: Whitening, k: int) -> np.ndarray:
    """Whitened values of grid rows on the first ``k`` components."""
    far = centred(x, model.n, model.sums).astype(float) / model.n
    return far @ model.vectors[:, :k] / np.sqrt(model.values[:k])


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error) of each vector that takes part and each component.

    ``components`` of the largest eigenvalues come out, or as many as vectors have entries, and are numbered from 1. identity_error, the largest
    absolute entry of the whitened values' covariance minus the identity, is measured over all rows. The input is read four times, no row is
    shuffled, and the values of the model are of the size of one covariance.

    Vectors that are null, empty or hold an entry that is null, not finite or of 2 ** 30 or more take no part, nor do those of another length
    than the commonest (of ties the longest). Repeated rows and ids count each; a null id stays null; other columns go; with no vector left
    there are no rows. A component whose eigenvalue is zero up to rounding, as of equal vectors, has null as whitened, and as explained if
    the trace is zero; it has no part in identity_error, which is null if no component is left.
    """
    schema = f"vec_id {vectors.schema[vec_id].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(vectors, embedding)
    dims = len(model.sums)
    count = min(components, dims)
    if not count:
        return vectors.sparkSession.createDataFrame([], schema)
    whole = int(model.whole[:count].sum())
    error = None
    if whole:
        error = float(np.abs(products(vectors, embedding, dims, whole, lambda x: projected(x, model, whole)) / model.n - np.eye(whole)).max())
    explained = [float(v / model.trace) if model.trace else None for v in model.values[:count]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = grid(batch.column(1), dims)
            far = centred(x, model.n, model.sums)
            if far.dtype != object and (not len(far) or int(np.abs(far).max()) ** 2 * dims < 1 << 63):
                deviation = pa.array((far * far).sum(1)).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([Decimal(sum(v * v for v in row)) for row in far.tolist()], pa.decimal128(38, 0))
            white = np.full((len(at), count), np.nan)
            white[:, :whole] = projected(x, model, whole)
            again = np.repeat(np.arange(len(at)), count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)).take(pa.array(again)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(at))), pa.array(np.full(len(again), model.n, np.int64)),
                    deviation.take(pa.array(again)), pa.array(white.ravel(), from_pandas=True), pa.array(explained * len(at), pa.float64()), pa.array([error] * len(again), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.select(vec_id, embedding).mapInArrow(rows, schema)
