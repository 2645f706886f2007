"""Whitening of embeddings by polarised covariances.

A covariance is half of what the variance of a sum of two dimensions has beyond the
variances of both. So tasks sum squares only: of every dimension and of the sum of every pair
of dimensions. Entries are whole numbers and are first taken relative to the rounded mean, so
squares are small and sums exact; the exact remainder of the mean is taken off when the few
sums are put together. One row a pair of dimensions leaves the cluster, none of the vectors.

Rows take no part if the vector is null, an entry is null or not finite, or beyond what
fifty bits hold once scaled. Vectors of another length than most have entries missing in
effect and take no part either. Repeated rows each count. A component without variance has no
scale: its whitened values are null, and it doesn't enter the identity error. ``deviation``
is null beyond the range of a long. Null ids stay null. An empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm import vectors
from logweir.llm.store import written

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Entries beyond this, scaled, are no entries.
RANGE = 2**50
#: Rows squared at once in a task.
BLOCK = 4096
#: An eigenvalue below this share of the largest, for each dimension, is rounding.
NOISE = 1e-15
WIDE = pa.decimal128(38, 0)
CONTEXT = Context(prec=40)


def whole(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    """Vectors of a batch as whole numbers."""
    return np.floor(SCALE * vectors.matrix(batch.column(column))).astype(np.int64) + OFFSET


def summed(values: np.ndarray) -> np.ndarray:
    """Exact column sums, as Python's numbers where a long could overflow."""
    most = int(np.abs(values).max(initial=0)) * len(values)
    return values.sum(axis=0) if most < 2**62 else values.astype(object).sum(axis=0)


def square_sums(values: np.ndarray) -> np.ndarray:
    """Exact sums of squares of each column."""
    if int(np.abs(values).max(initial=0)) ** 2 * len(values) < 2**62:
        return (values * values).sum(axis=0)
    values = values.astype(object)
    return (values * values).sum(axis=0)


def sums_table(first: np.ndarray, second: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    exact = pa.array([CONTEXT.create_decimal(int(x)) for x in sums], WIDE)
    return pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), exact], names=["first", "second", "total"])


def fit_rows(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows that take part, and the number of their dimensions."""
    scaled = F.forall(vector, lambda x: F.abs(x.cast("double")) * SCALE < float(RANGE))
    usable = rows.where(vectors.finite(F.col(vector)) & scaled)
    sizes = usable.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = sizes[0]["size"] if sizes else 0
    return usable.where(F.size(vector) == size), size


def means(fit: DataFrame, vector: str) -> tuple[int, list[int]]:
    """Number of rows and the sum of every dimension."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                values = whole(batch.slice(at, BLOCK))
                rows, total = rows + len(values), total + summed(values).astype(object)
        if rows:
            # The row count is the place before the first dimension.
            yield sums_table(np.arange(-1, len(total)), np.arange(-1, len(total)), np.array([rows, *total], object))

    found = fit.select(vector).mapInArrow(added, "first int, second int, total decimal(38,0)").groupBy("first").agg(F.sum("total").alias("total"))
    sums = [int(row["total"]) for row in found.orderBy("first").collect()]
    return (sums[0], sums[1:]) if sums else (0, [])


def covariances(fit: DataFrame, vector: str, n: int, sums: list[int]) -> np.ndarray:
    """The covariance of the whole entries: variances of dimensions and of sums of two, and their differences."""
    size = len(sums)
    middle = np.array([round_half(total, n) for total in sums])
    first, second = np.triu_indices(size, 1)

    def squared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone, paired, seen = np.zeros(size, object), np.zeros(len(first), object), False
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                values, seen = whole(batch.slice(at, BLOCK)) - middle, True
                alone = alone + square_sums(values).astype(object)
                pairs = [square_sums(values[:, [k]] + values[:, k + 1 :]).astype(object) for k in range(size - 1)]
                paired = paired + (np.concatenate(pairs) if pairs else np.zeros(0, object))
        if seen:
            every = np.arange(size)
            yield sums_table(np.concatenate([every, first]), np.concatenate([every, second]), np.concatenate([alone, paired]))

    found = fit.select(vector).mapInArrow(squared, "first int, second int, total decimal(38,0)").groupBy("first", "second").agg(F.sum("total").alias("total"))
    squares = {(row["first"], row["second"]): int(row["total"]) for row in found.collect()}
    # n times the sum of squares about the mean, whole: what the rounded mean left over is taken off here.
    left = [total - n * int(m) for total, m in zip(sums, middle)]
    spread = {(a, b): n * x - (left[a] + (left[b] if a != b else 0)) ** 2 for (a, b), x in squares.items()}
    found = np.empty((size, size))
    for (a, b), x in spread.items():
        found[a, b] = found[b, a] = x / (n * n) if a == b else (x - spread[a, a] - spread[b, b]) / (2 * n * n)
    return found


def round_half(total: int, n: int) -> int:
    return (2 * total + n) // (2 * n)


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as rows; the largest entry of each is positive."""
    values, columns = np.linalg.eigh(covariance)
    values, rows = values[::-1][:most], columns.T[::-1][:most]
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])
    return np.where(values > NOISE * len(covariance) * max(values.max(initial=0), 0), values, 0), rows * signs[:, None]


def projected(fit: DataFrame, vec_id: str, vector: str, n: int, sums: list[int], values: np.ndarray, axes: np.ndarray) -> DataFrame:
    """``vec_id, deviation, whitened`` (one value a component) of every row."""
    middle = np.array([round_half(total, n) for total in sums])
    left = [total - n * int(m) for total, m in zip(sums, middle)]
    rest = np.array([x / n for x in left])
    scale = np.sqrt(values)
    rows = fit.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = whole(batch, 1) - middle
            # n * x - S in full: products with n may need more than a long holds.
            if (int(np.abs(entries).max(initial=0)) + 1) ** 2 * n * n * entries.shape[1] < 2**62:
                apart = n * entries - np.array(left, np.int64)
                far = (apart * apart).sum(axis=1).tolist()
            else:
                far = ((n * entries.astype(object) - np.array(left, object)) ** 2).sum(axis=1).tolist()
            with np.errstate(divide="ignore", invalid="ignore"):
                white = (entries - rest) @ axes.T / scale
            flat = pa.array(white.ravel(), mask=np.broadcast_to(scale == 0, white.shape).ravel())
            offsets = pa.array(np.arange(0, white.size + 1, max(1, white.shape[1])), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x if x < 2**63 else None for x in far], pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                names=["vec_id", "deviation", "whitened"],
            )

    return rows.mapInArrow(project, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>")


def identity_error(white: DataFrame, values: np.ndarray) -> float | None:
    """Largest difference of the covariance of the written values from the identity."""
    scaled = [k for k, value in enumerate(values) if value > 0]
    pairs = [(a, b) for a in scaled for b in scaled if a <= b]
    if not pairs:
        return None
    entry = lambda k: F.col("whitened")[k]
    row = white.agg(*[F.abs(F.covar_pop(entry(a), entry(b)) - F.lit(float(a == b))).alias(f"_{a}_{b}") for a, b in pairs]).first()
    return max(row)


def whiten(rows: DataFrame, most: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every row and component."""
    fit, size = fit_rows(rows, vector)
    out = "vec_id, component, n, deviation, whitened, explained, identity_error".split(", ")
    n, sums = means(fit, vector) if size else (0, [])
    if not n:
        kind = rows.schema[vec_id].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    covariance = covariances(fit, vector, n, sums)
    values, axes = components(covariance, most)
    white = written(projected(fit, vec_id, vector, n, sums, values, axes), "whitened")
    total = float(np.trace(covariance))
    shares = F.array(*[F.lit(float(value) / total if total else None).cast("double") for value in values])
    found = white.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened")).select(
        "vec_id",
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("_at")].alias("explained"),
        F.lit(identity_error(white, values)).cast("double").alias("identity_error"),
    )
    return found.select(out)
