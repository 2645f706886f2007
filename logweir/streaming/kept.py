"""What a stream keeps from batch to batch: one snapshot in a folder, by batch number.

A batch reads the snapshot of the batch before it and writes its own, so a replayed batch
finds what it found the first time and overwrites what it wrote. Older snapshots go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BATCH = "batch_id"


def _at(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, files = _at(spark, path)
    return files.exists(hadoop)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it is not there."""
    hadoop, files = _at(spark, folder)
    return [status.getPath().getName() for status in files.listStatus(hadoop)] if files.exists(hadoop) else []


def before(spark: SparkSession, folder: str, batch_id: int, part: str = "") -> DataFrame | None:
    """The snapshot that the batch before left, or a part of it."""
    path = f"{folder}/{BATCH}={batch_id - 1}{part}"
    return spark.read.parquet(path) if exists(spark, path) else None


def write(rows: DataFrame, folder: str, batch_id: int, *parts: str) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*parts) if parts else writer).parquet(f"{folder}/{BATCH}={batch_id}")


def forget(spark: SparkSession, folder: str, batch_id: int, part: str = "") -> None:
    """Remove the snapshot that neither this batch nor a replay of it reads."""
    hadoop, files = _at(spark, f"{folder}/{BATCH}={batch_id - 2}{part}")
    if files.exists(hadoop):
        files.delete(hadoop, True)


def last_finished(spark: SparkSession, folder: str) -> int | None:
    """Number of the last batch whose snapshot is complete."""
    numbers = sorted((int(name.split("=")[1]) for name in names(spark, folder) if name.startswith(f"{BATCH}=")), reverse=True)
    return next((number for number in numbers if exists(spark, f"{folder}/{BATCH}={number}/_SUCCESS")), None)
