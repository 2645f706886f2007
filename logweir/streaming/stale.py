"""Nodes that made no progress within their time-out, as a stream.

Each micro-batch is reduced to the newest event per node and merged with the nodes that are
still watched. A node whose deadline the watermark has passed is reported once and leaves;
one that waits for nothing leaves when the watermark has passed its last event. So a batch
reads and writes the watched nodes only, and no Python runs for a node. A replayed batch
finds what it found the first time and overwrites what it wrote.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from logweir.operators.nodes import TIMED_STATUSES, Timeouts
from logweir.streaming import kept
from logweir.streaming.kept import BATCH

PART, WATCHED, REPORTED, CLOCK = "part", "watched", "stale", "clock"
KEYS = ["job_id", "node_id"]


def deadline(status: Column, at: Column, timeouts: Timeouts) -> Column:
    """When a node of this status is stale, in milliseconds; null if it waits for nothing."""
    limits = {
        "RUNNING": timeouts.running_seconds,
        "QUEUED": timeouts.queue_seconds,
        "WAITING_PROVIDER": max(1.0, timeouts.provider_retry_seconds),
    }
    assert set(limits) == set(TIMED_STATUSES)
    return fold(lambda chain, entry: F.when(status == entry[0], at + int(entry[1] * 1000)).otherwise(chain), limits.items(), F.lit(None).cast("long"))


def _newest(rows: DataFrame) -> DataFrame:
    """One row per node; ``fresh`` if any of its rows may count."""
    version = F.struct("event_millis", "event_id")
    newest = rows.groupBy(*KEYS).agg(F.max(version).alias("_version"), F.max_by("node_status", version).alias("node_status"), F.bool_or("fresh").alias("fresh"))
    return newest.select(*KEYS, "node_status", "_version.*", "fresh")


def stream_stale_nodes(node_events: DataFrame, folder: str, delay: str = "0 seconds", timeouts: Timeouts = Timeouts()) -> DataStreamWriter:
    """A writer that reports each node whose time-out has passed, once.

    The watermark is the newest event time so far less ``delay``. An event behind the watermark
    of the batches before counts only for a node that is still watched.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clock = kept.before(spark, folder, batch_id, f"/{PART}={CLOCK}")
        old = clock.first()["event_millis"] if clock is not None else None
        new = batch.select(F.unix_millis(F.max(F.col("event_time").cast("timestamp")) - F.expr(f"interval {delay}"))).first()[0]
        now = max((at for at in (old, new) if at is not None), default=None)
        at = F.unix_millis(F.col("event_time").cast("timestamp"))
        fresh = F.lit(True) if old is None else at >= old
        rows = _newest(batch.select(*KEYS, "node_status", at.alias("event_millis"), "event_id", fresh.alias("fresh")))
        before = kept.before(spark, folder, batch_id, f"/{PART}={WATCHED}")
        if before is not None:
            rows = _newest(rows.unionByName(before.select(*KEYS, "node_status", "event_millis", "event_id", F.lit(True).alias("fresh"))))
        due = deadline(F.col("node_status"), F.col("event_millis"), timeouts)
        judged = rows.where("fresh").drop("fresh").withColumn("stale_millis", due)
        state = (
            F.when(F.col("stale_millis") < F.lit(now), REPORTED)
            .when(F.col("stale_millis").isNotNull() | (F.col("event_millis") >= F.lit(now)), WATCHED)
        )
        told = judged.withColumn(PART, state).where(F.col(PART).isNotNull())
        shape = told.schema
        time = spark.range(1).select(*[F.lit({"event_millis": now, PART: CLOCK}.get(field.name)).cast(field.dataType).alias(field.name) for field in shape])
        kept.write(told.unionByName(time), folder, batch_id, PART)
        for part in (WATCHED, CLOCK):
            kept.forget(spark, folder, batch_id, f"/{PART}={part}")

    return node_events.writeStream.foreachBatch(store)


def read_stale_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """All reports so far: job_id, node_id, node_status, updated_at, stale_at."""
    stored = spark.read.option("basePath", folder).parquet(folder)
    reports = stored.where((F.col(PART) == REPORTED) & (F.col(BATCH) <= kept.last_finished(spark, folder)))
    return reports.select(
        *KEYS, "node_status", F.timestamp_millis("event_millis").alias("updated_at"), F.timestamp_millis("stale_millis").alias("stale_at")
    )
