"""Vectors for searches: usable rows, matrices, and a query set that meets all rows in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.store import written

ROW = "_row"
#: Components a shard of rows or a block of queries has at most, and below which a shard is not split for idle cores.
SHARD, LEAST_SHARD = 1 << 22, 1 << 18
#: Queries that a task looks up at once.
STEP = 1 << 11
#: Rows of the sample whose scores give first bounds. A bound only ever saves work.
SAMPLE = 1 << 11


def finite(vector: Column) -> Column:
    """Whether a vector is there, with every component a number."""
    held = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & held, F.lit(False))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written with a number for each row, so that equal rows can be told apart and dealt out."""
    return written(rows.withColumn(ROW, F.monotonically_increasing_id()), name)


def matrix(lists: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Lists of numbers as rows of doubles, shorter ones filled up with zeros to ``width`` at least."""
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    sizes = np.diff(np.asarray(lists.offsets))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(width, int(sizes.max(initial=0)))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    found = np.zeros((len(sizes), width))
    found[np.arange(width) < sizes[:, None]] = flat
    return found


def ids(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as longs, null ones as the largest, and which of them are null."""
    return column.fill_null(np.iinfo(np.int64).max).to_numpy().astype(np.int64), np.asarray(column.is_null())


def restored(values: np.ndarray, missing: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=missing)


def sample(rows: DataFrame) -> pa.Table:
    """A fixed number of rows, by hash, for first bounds."""
    return rows.orderBy(F.xxhash64(ROW)).limit(SAMPLE).toArrow()


#: From a shard and the width of all vectors to what answers a step of queries.
Prepare = Callable[[pa.Table, int], Callable[[pa.Table], pa.Table]]


def met(queries: DataFrame, rows: DataFrame, prepare: Prepare, schema: str) -> DataFrame:
    """Every block of ``queries`` with every shard of ``rows``; both are numbered and have a ``vector``.

    Rows and queries are dealt by the hash of their number, so copies spread like any
    other rows. A task holds one shard and one block of about the same size, however large
    the tables and the vectors are: with fewer rows in either, the other would be sent more often.
    """
    count, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    asked, held = queries.count(), max(1, SHARD // max(1, width))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-count // held), min(cores, count * width // LEAST_SHARD))
    blocks = max(1, -(-asked // held))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64(ROW), F.lit(n)).cast("int")

    def work(block: pa.Table, shard: pa.Table) -> pa.Table:
        answer = prepare(shard, width)
        return pa.concat_tables([answer(block.slice(at, STEP)) for at in range(0, max(1, block.num_rows), STEP)])

    left = queries.withColumn("_block", dealt(blocks)).withColumn("_shard", every(shards))
    right = rows.withColumn("_shard", dealt(shards)).withColumn("_block", every(blocks))
    return left.groupBy("_shard", "_block").cogroup(right.groupBy("_shard", "_block")).applyInArrow(work, schema)
