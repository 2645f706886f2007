"""Appends that are replay-safe, over one table or several together.

Every append is a folder ``commit=<key>`` of its table, written whole, so that doing it again with
the same key replaces it. Several tables are written together under one key, and a small
file of that name in ``_commits`` is put there last, by rename. Readers leave out what
belongs to a key that is not there yet: a run that stopped between two tables is not seen, and
its replay overwrites what it left.
"""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "commit"
#: Keys of commits over several tables begin with this.
TOGETHER = "together-"
MANIFEST = "_commits"


def _at(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put(rows: DataFrame, root: str, table: str, order: Sequence[str], commit: str | None = None) -> None:
    """Append rows, sorted inside each file; with a key, a second append of the same key replaces the first."""
    rows.drop(COMMIT).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{root}/{table}/{COMMIT}={commit or uuid4().hex}")


def committed(spark: SparkSession, root: str) -> list[str]:
    """Keys of the finished commits over several tables."""
    path, files = _at(spark, f"{root}/{MANIFEST}")
    return [status.getPath().getName() for status in files.listStatus(path)] if files.exists(path) else []


def finish(spark: SparkSession, root: str, commit: str) -> None:
    """Make all that was written under a key visible at once."""
    target, files = _at(spark, f"{root}/{MANIFEST}/{commit}")
    part, _ = _at(spark, f"{root}/.{commit}.{uuid4().hex}")
    files.mkdirs(target.getParent())
    files.create(part, True).close()
    if not files.rename(part, target) and not files.exists(target):
        raise OSError(f"the commit {commit} could not be finished")


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """A state table as of its finished commits, or None before its first append."""
    path, files = _at(spark, f"{root}/{table}")
    if not files.exists(path) or not len(files.listStatus(path)):
        return None
    rows = spark.read.option("recursiveFileLookup", "false").parquet(f"{root}/{table}")
    if COMMIT not in rows.columns:
        return rows
    rows = rows.withColumn(COMMIT, F.col(COMMIT).cast("string"))
    alone = rows.where(~F.col(COMMIT).startswith(TOGETHER))
    done = spark.createDataFrame([(key,) for key in committed(spark, root)], f"{COMMIT} string")
    return alone.unionByName(rows.where(F.col(COMMIT).startswith(TOGETHER)).join(done, COMMIT, "left_semi")).drop(COMMIT)
