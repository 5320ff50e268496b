"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, OFFSET = 64, 1_000_000
# Entries beyond are taken as this; a long holds them and so do the sums of products.
FARTHEST = 1e15
_LIMB = 26
_CHUNK = 65_536
_PARTIALS = "chunk int, weight int, high binary, low binary"


def sound(vector: Column) -> Column:
    """The vector is there and all of its entries are finite numbers."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _grid(vector: Column) -> Column:
    """floor(64 * entry) as longs; the offset of the contract cancels in all that follows."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(SCALE * x.cast("double"), F.lit(FARTHEST)), F.lit(-FARTHEST))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _products(z: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(power of two, whole-number matrix) whose weighted sum is [1 z]' [1 z], exactly, from float products below 2**53."""
    low = z % (1 << _LIMB) if np.abs(z).max(initial=0) >= 1 << _LIMB else z
    high = (z - low) >> _LIMB
    parts = [np.column_stack([np.ones(len(z), np.int64), low]).astype(np.float64)]
    if high.any():
        parts.append(np.column_stack([np.zeros(len(z), np.int64), high]).astype(np.float64))
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            most = max(1.0, np.abs(a).max(initial=0) * np.abs(b).max(initial=0))
            step = max(1, int(2.0**53 / most))
            for at in range(0, len(z), step):
                yield (i + j) * _LIMB, (a[at:at + step].T @ b[at:at + step]).astype(np.int64)


def _emitted(sums: dict[tuple[int, int], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for (chunk, weight), (high, low) in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int32()), pa.array([weight], pa.int32()), pa.array([high.tobytes()], pa.binary()), pa.array([low.tobytes()], pa.binary())],
            names=["chunk", "weight", "high", "low"])


def _add(sums: dict, key: tuple[int, int], high: np.ndarray, low: np.ndarray) -> None:
    """Two-limb sums: value = high * 2**32 + low with low in 0..2**32-1, so no sum of tasks overflows."""
    have = sums.get(key)
    if have is not None:
        high, low = have[0] + high, have[1] + low
    sums[key] = [high + (low >> 32), low & 0xFFFFFFFF]


def _scatter(width: int):
    """Count, sums and products of the rows of a task: the upper triangle of [1 z]' [1 z], in chunks."""
    rows, columns = np.triu_indices(width + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for weight, product in _products(_matrix(batch.column(0), width)):
                packed = product[rows, columns]
                for chunk, at in enumerate(range(0, len(packed), _CHUNK)):
                    values = packed[at:at + _CHUNK]
                    _add(sums, (chunk, weight), values >> 32, values & 0xFFFFFFFF)
        yield from _emitted(sums)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict = {}
    for batch in batches:
        for row in batch.to_pylist():
            _add(sums, (row["chunk"], row["weight"]), np.frombuffer(row["high"], np.int64), np.frombuffer(row["low"], np.int64))
    yield from _emitted(sums)


def scatter_sums(grid: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """Exact count, sums and raw products of a column of long vectors; added up in tasks, then in two steps."""
    partial = grid.mapInArrow(_scatter(width), _PARTIALS)
    groups = math.isqrt(int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    # Some tasks' sums meet in each group, the groups' sums at the end: no task adds up all of them.
    salted = partial.withColumn("group", F.spark_partition_id() % groups).repartition(groups, "chunk", "group").select("chunk", "weight", "high", "low")
    added = salted.mapInArrow(_added, _PARTIALS).repartition(groups, "chunk").mapInArrow(_added, _PARTIALS)
    entries = (width + 1) * (width + 2) // 2
    total = [0] * entries
    # As many numbers as the triangle has, whatever the number of rows.
    for row in added.collect():
        high, low = np.frombuffer(row.high, np.int64).tolist(), np.frombuffer(row.low, np.int64).tolist()
        for k, (h, x) in enumerate(zip(high, low), start=row.chunk * _CHUNK):
            total[k] += ((h << 32) + x) << row.weight
    square, at = [[0] * (width + 1) for _ in range(width + 1)], 0
    for i in range(width + 1):
        for j in range(i, width + 1):
            square[i][j] = square[j][i] = total[at]
            at += 1
    return square[0][0], square[0][1:], [row[1:] for row in square[1:]]


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """G with G G' = matrix: the triangular factor with its rows back in place, one column for each pivot that is left.

    The largest remaining diagonal entry leads each step; what rounding alone leaves ends it, so a matrix of less than
    full rank gives fewer columns.
    """
    rest, n = matrix.copy(), len(matrix)
    factor = np.zeros((n, n), matrix.dtype)
    floor = np.diag(matrix).max(initial=0) * n * np.finfo(matrix.dtype).eps
    open_rows = np.ones(n, bool)
    for k in range(n):
        diagonal = np.where(open_rows, np.diag(rest), -1)
        pivot = int(diagonal.argmax())
        if diagonal[pivot] <= floor:
            return factor[:, :k]
        column = np.where(open_rows, rest[:, pivot], 0) / np.sqrt(rest[pivot, pivot])
        column[pivot] = np.sqrt(rest[pivot, pivot])
        factor[:, k] = column
        rest -= np.outer(column, column)
        open_rows[pivot] = False
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors) of factor factor', largest first: columns are turned until all are orthogonal.

    Each step turns disjoint pairs of columns at once, each sweep meets every pair once.
    """
    g, (n, width) = factor.copy(), factor.shape
    places = list(range(width + width % 2))
    enough = np.finfo(g.dtype).eps * max(n, 1)
    for _ in range(sweeps):
        turned = False
        for _ in range(max(len(places) - 1, 0)):
            pairs = [(a, b) for a, b in zip(places[:len(places) // 2], reversed(places[len(places) // 2:])) if a < width and b < width]
            places = [places[0], places[-1], *places[1:-1]]
            p, q = np.array([min(x) for x in pairs], int), np.array([max(x) for x in pairs], int)
            a, b = g[:, p], g[:, q]
            alpha, beta, gamma = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            do = np.abs(gamma) > enough * np.sqrt(alpha * beta)
            if not do.any():
                continue
            turned = True
            zeta = (beta - alpha) / np.where(do, 2 * gamma, 1)
            t = np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            cosine = np.where(do, 1 / np.sqrt(1 + t * t), 1)
            sine = np.where(do, cosine * t, 0)
            g[:, p], g[:, q] = cosine * a - sine * b, sine * a + cosine * b
        if not turned:
            break
    norms = np.sqrt((g * g).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    vectors = g[:, order] / norms[order]
    # Either sign is right; the largest entry is positive, so that every run gives the same.
    signs = np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1, 1) if len(order) else 1
    return norms[order] ** 2, vectors * signs


@dataclass(frozen=True)
class Whitening:
    """A fit: row count, exact sums of floor(64 * entry), the leading components (a column each), their eigenvalues, and the trace of the covariance."""

    width: int
    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def fit(vectors: DataFrame, column: str = "embedding", components: int = 32) -> Whitening | None:
    """The covariance of all sound vectors (divisor n) and its leading components; None without any vector.

    Sums and products are exact whole numbers, so centring by them loses nothing. The factor and its rotations are done on
    the driver in extended precision; its work depends on the number of dimensions alone. Vectors of another length than
    the most frequent one (the longer in a tie) take no part. Directions in which the data does not vary have no
    component, so there may be fewer than asked for.
    """
    width = most_frequent_length(vectors, column)
    if width is None:
        return None
    grid = vectors.where(sound(F.col(column)) & (F.size(column) == width)).select(_grid(F.col(column)).alias("z"))
    n, sums, raw = scatter_sums(grid, width)
    extended = np.longdouble
    square = extended(n) * extended(n)
    covariance = np.array([[extended(str(n * raw[i][j] - sums[i] * sums[j])) / square for j in range(width)] for i in range(width)], extended).reshape(width, width)
    values, found = one_sided_jacobi(pivoted_cholesky(covariance))
    return Whitening(width, n, tuple(sums), found[:, :components].astype(np.float64), values[:components].astype(np.float64), float(np.trace(covariance)))


def most_frequent_length(vectors: DataFrame, column: str) -> int | None:
    size = F.size(column)
    top = vectors.where(sound(F.col(column))).groupBy(size.alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return None if top is None else top.width


def _whitened(model: Whitening):
    middle = np.array([s // model.n for s in model.sums], np.int64)
    over = [s - model.n * m for s, m in zip(model.sums, middle.tolist())]
    rest = np.array([x / model.n for x in over])
    turn = model.components / np.sqrt(model.eigenvalues)

    def deviations(z: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)**2 as whole numbers; None where a long does not hold it."""
        apart = z - middle
        most = model.n * (int(np.abs(apart).max(initial=0)) + 1)
        if most * most * model.width < 2**62:
            return (((model.n * apart - np.array(over, np.int64)) ** 2).sum(axis=1)).tolist()
        exact = [sum((model.n * x - o) ** 2 for x, o in zip(row, over)) for row in apart.tolist()]
        return [x if x < 2**63 else None for x in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _matrix(batch.column(batch.num_columns - 1), model.width)
            values = ((z - middle).astype(np.float64) - rest) @ turn
            offsets = np.arange(len(z) + 1, dtype=np.int32) * values.shape[1]
            added = [pa.array(deviations(z), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """The rows with a sound vector of the fitted length, with `deviation` long and `whitened` array<double>.

    `whitened` is (x - S/n) projected on each component, over the root of its eigenvalue; `deviation` is the exact sum of
    (n*x - S)**2, null beyond a long. Other columns stay, null ids too; a column with one of the two names is replaced. Equal
    and repeated rows each have their result. Entries beyond 1e15 after scaling count as 1e15.
    """
    rows = vectors.where(sound(F.col(column)) & (F.size(column) == model.width)).drop("deviation", "whitened").withColumn("__grid", _grid(F.col(column)))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(_whitened(model), schema)


def identity_error(whitened: DataFrame, components: int) -> float:
    """The largest absolute entry of the covariance of `whitened` minus the identity, over all rows."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((components + 1, components + 1))
        for batch in batches:
            one = np.column_stack([np.ones(batch.num_rows), _matrix(batch.column(0), components)])
            total += one.T @ one
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["m"])

    parts = whitened.select("whitened").mapInArrow(moments, "m array<double>").select(F.posexplode("m").alias("k", "x"))
    # (components + 1) squared numbers.
    total = np.zeros((components + 1) ** 2)
    for row in parts.groupBy("k").agg(F.sum("x").alias("x")).collect():
        total[row.k] = row.x
    total = total.reshape(components + 1, components + 1) / total[0]
    mean = total[0, 1:]
    return float(np.abs(total[1:, 1:] - np.outer(mean, mean) - np.eye(components)).max(initial=0.0))
