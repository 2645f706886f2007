"""Intermediate tables in the shared folder, and ranks over any number of rows."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.session import ensure_checkpoint_dir

RANK = "_rank"
_PART = "_rank_part"


def new_folder(spark, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut, columns stay prunable.

    The table survives lost executors and is read as often as needed. Whoever owns
    ``spark.checkpoint.dir`` removes it with the rest of the run.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ranked(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` (narrow) with ``_rank``, the 1-based place of each row in a total order.

    Rows are range-partitioned and numbered inside their partition; the rows before a
    partition come from a table with one row per partition.
    """
    # The partition number is part of the written rows, so later passes agree on it.
    parts = written(df.repartitionByRange(*order).withColumn(_PART, F.spark_partition_id()), "ranked")
    before = F.sum("_n").over(Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.groupBy(_PART).agg(F.count("*").alias("_n")).select(_PART, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(_PART).orderBy(*order))
    return (
        parts.withColumn(RANK, inside)
        .join(offsets, _PART)
        .withColumn(RANK, F.col(RANK) + F.col("_before"))
        .drop(_PART, "_before")
    )
