"""Neighbour rows within a key, for keys of any size.

``lag`` over a window puts each key into one task. Here rows are range-partitioned
by (key, order) instead; the window runs inside each partition, and the row before a
partition's first row comes from a table with one row per partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.session import cut

PART = "_part"
BROADCAST_PARTITIONS = 20_000


def _neighbours(
    df: DataFrame, key: str, order: Sequence[str], values: Mapping[str, Column], forward: bool
) -> DataFrame:
    carried = [value.alias(name) for name, value in values.items()]
    ranged = df.withColumn("_value", F.struct(*carried)).repartitionByRange(key, *order)
    rows = cut(ranged.withColumn(PART, F.spark_partition_id()))

    # One row per partition: its outermost row on the side the neighbours look at.
    outermost = F.struct(key, *order)
    pick = F.min_by if forward else F.max_by
    edges = rows.groupBy(PART).agg(pick(F.struct(F.col(key).alias("_edge_key"), "_value"), outermost).alias("_edge"))
    across = Window.orderBy(F.desc(PART) if forward else F.asc(PART))
    beyond = edges.select(PART, F.lag("_edge").over(across).alias("_beyond"))

    directed = [F.desc(name) if forward else F.asc(name) for name in order]
    inside = Window.partitionBy(PART, key).orderBy(*directed)
    near = F.coalesce(
        F.lag("_value").over(inside),
        F.when(F.col("_beyond._edge_key") == F.col(key), F.col("_beyond._value")),
    )
    # One row per partition: small unless there are very many partitions.
    if rows.rdd.getNumPartitions() <= BROADCAST_PARTITIONS:
        beyond = F.broadcast(beyond)
    return (
        rows.join(beyond, PART, "left")
        .withColumn("_near", near)
        .select(*df.columns, *[F.col(f"_near.{name}").alias(name) for name in values])
    )


def with_previous(df: DataFrame, key: str, order: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Add ``values`` of the previous row of the same key; null on the first row."""
    return _neighbours(df, key, order, values, forward=False)


def with_next(df: DataFrame, key: str, order: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Add ``values`` of the next row of the same key; null on the last row."""
    return _neighbours(df, key, order, values, forward=True)
