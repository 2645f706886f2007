"""Current state that follows the event logs.

Each micro-batch is reduced to one partial row per key (newest row, last time, number of
events) and merged with the partials of the keys that are still open. What comes out is one
snapshot of open keys; a key whose newest status is an end leaves it and is written once
to the closed rows. So a batch reads and writes the open keys only, however long the log
is, and the snapshot shrinks as jobs end. Partials merge with the same aggregate: an event after
the end opens the key anew, and a read merges its partials. A replayed batch
overwrites its own folder, and a hot job is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from logweir.operators.jobs import TERMINAL_STATUSES, one_shape
from logweir.streaming import kept
from logweir.streaming.kept import BATCH

CLOSED = "closed"
OPEN_PART = f"/{CLOSED}=false"

JOB_KEYS = ["job_id"]
JOB_VALUES = ["job_status", "event_type"]
NODE_KEYS = ["job_id", "node_id"]
NODE_VALUES = ["node_type", "level", "node_index", "node_status", "event_type"]


def partial_state(events: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key: the newest values with their version, and the event count."""
    version = F.struct("event_time", "event_id")
    newest = F.max_by(F.struct(*values), version)
    return (
        events.groupBy(*keys)
        .agg(newest.alias("_values"), F.max(version).alias("version"), F.count("*").alias("events_count"))
        .select(*keys, "_values.*", "version", "events_count")
    )


def merge_partials(partials: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    newest = F.max_by(F.struct(*values), F.col("version"))
    return (
        partials.groupBy(*keys)
        .agg(newest.alias("_values"), F.max("version").alias("version"), F.sum("events_count").alias("events_count"))
        .select(*keys, "_values.*", "version", "events_count")
    )


def ended(values: Sequence[str]):
    """Whether the newest status of a key is an end."""
    status = next(name for name in values if name.endswith("_status"))
    return F.coalesce(F.upper(F.trim(F.col(status))).isin(TERMINAL_STATUSES), F.lit(False))


def stream_current_state(
    events: DataFrame, folder: str, keys: Sequence[str] = JOB_KEYS, values: Sequence[str] = JOB_VALUES
) -> DataStreamWriter:
    """A writer that keeps the state of a streaming event log in ``folder``."""

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = partial_state(batch, keys, values)
        before = kept.before(spark, folder, batch_id, OPEN_PART)
        if before is not None:
            rows = merge_partials(rows.unionByName(before), keys, values)
        kept.write(rows.withColumn(CLOSED, ended(values)), folder, batch_id, CLOSED)
        kept.forget(spark, folder, batch_id, OPEN_PART)

    return events.writeStream.foreachBatch(store)


def read_partials(spark: SparkSession, folder: str, keys: Sequence[str], only: DataFrame | None = None) -> DataFrame:
    """The open rows of the last snapshot and all closed rows, of the keys of ``only`` if given."""
    stored = spark.read.option("basePath", folder).parquet(folder)
    rows = stored.where(F.col(CLOSED).cast("boolean") | (F.col(BATCH) == kept.last_finished(spark, folder)))
    return rows if only is None else rows.join(only.select(*keys).distinct(), list(keys), "left_semi")


def read_current_state(
    spark: SparkSession,
    folder: str,
    keys: Sequence[str] = JOB_KEYS,
    values: Sequence[str] = JOB_VALUES,
    only: DataFrame | None = None,
) -> DataFrame:
    """Current state from the partials, in the shape of the batch read models."""
    merged = merge_partials(read_partials(spark, folder, keys, only), keys, values)
    shown = [name for name in values if name != "event_type"]
    return merged.select(
        *keys,
        *shown,
        F.col("event_type").alias("last_event_type"),
        F.col("version.event_time").alias("updated_at"),
        "events_count",
    )


def compact_state(
    spark: SparkSession, folder: str, target: str, keys: Sequence[str] = JOB_KEYS, values: Sequence[str] = JOB_VALUES
) -> None:
    """Fold all partials of a stopped stream into one snapshot under ``target``.

    Batch numbers start at 0, so it takes number -1 and the stream can go on writing to ``target``.
    """
    merged = merge_partials(read_partials(spark, folder, keys).drop(BATCH, CLOSED), keys, values)
    kept.write(merged.withColumn(CLOSED, ended(values)), target, -1, CLOSED)


def stream_recent_events(job_events: DataFrame, node_events: DataFrame, folder: str, limit: int = 200) -> DataStreamWriter:
    """A writer that keeps the newest ``limit`` events of both logs.

    Every batch stores the newest rows of itself and of the batch before it.
    """
    both = one_shape(job_events, "JOB").unionByName(one_shape(node_events, "NODE"))

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        before = kept.before(spark, folder, batch_id)
        if before is not None:
            rows = rows.unionByName(before)
        newest = rows.orderBy(F.desc("event_time"), F.desc("event_id"), F.desc("scope")).limit(limit)
        kept.write(newest, folder, batch_id)
        kept.forget(spark, folder, batch_id)

    return both.writeStream.foreachBatch(store)


def read_recent_events(spark: SparkSession, folder: str) -> DataFrame:
    """The rows the last finished batch left."""
    return spark.read.parquet(f"{folder}/{BATCH}={kept.last_finished(spark, folder)}")
