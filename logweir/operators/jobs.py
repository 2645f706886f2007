"""Read models over the job event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.operators.latest import newest_first
from logweir.operators.ordered import with_previous

# Event types and statuses the read models depend on.
START_EVENTS = ["INPUT_INGEST_STARTED", "JOB_RUNNING", "JOB_RESUMED"]
FINISH_EVENTS = ["JOB_DONE", "JOB_FAILED", "JOB_CANCELLED"]
TERMINAL_STATUSES = ["DONE", "FAILED", "CANCELLED"]
NOT_RUNNABLE = [
    "PAUSED",
    "INGESTING",
    "PAUSE_REQUESTED",
    "CANCEL_REQUESTED",
    "CANCELLED",
    "DONE",
    "FAILED",
]
RECOVERABLE = [
    "CREATED",
    "INGESTING",
    "INPUT_READY",
    "RUNNING",
    "RESUMED",
    "WAITING_RETRY",
    "WAITING_PROVIDER",
]

JOB_CURRENT = ["job_id", "job_status", "last_event_type", "updated_at", "events_count"]


def _version() -> Column:
    return F.struct("event_time", "event_id")


def _current_aggregates() -> list[Column]:
    newest = F.max_by(F.struct("job_status", "event_type"), _version())
    return [
        newest.alias("_newest"),
        F.max("event_time").alias("updated_at"),
        F.count("*").alias("events_count"),
    ]


def job_current(job_events: DataFrame) -> DataFrame:
    """Current status per job: the latest event by (event_time, event_id)."""
    return (
        job_events.groupBy("job_id")
        .agg(*_current_aggregates())
        .select(
            "job_id",
            F.col("_newest.job_status").alias("job_status"),
            F.col("_newest.event_type").alias("last_event_type"),
            "updated_at",
            "events_count",
        )
    )


def list_jobs(job_events: DataFrame, status: str | None = None, limit: int = 200) -> DataFrame:
    """Newest jobs; the status is that of the latest event, so it is tested afterwards."""
    jobs = job_current(job_events)
    if status:
        jobs = jobs.filter(F.col("job_status") == status)
    return newest_first(jobs, limit, F.desc("updated_at"), F.asc("job_id"))


def runnable_jobs(job_events: DataFrame) -> DataFrame:
    return job_current(job_events).filter(~F.col("job_status").isin(NOT_RUNNABLE))


def recoverable_jobs(job_events: DataFrame) -> DataFrame:
    """Jobs a restart picks up again, with the step to take, oldest first."""
    action = F.when(F.col("job_status") == "INGESTING", "ingest").otherwise("advance")
    jobs = job_current(job_events).filter(F.col("job_status").isin(RECOVERABLE))
    return jobs.withColumn("action", action).orderBy("updated_at", "job_id")


def job_lifecycle(job_events: DataFrame) -> DataFrame:
    """Current status plus created, started and finished times, in one aggregation.

    The finish time is that of the last finish event, even if the job was taken up
    again afterwards; a terminal job without one takes its last update.
    """
    kind = F.upper(F.trim("event_type"))
    grouped = job_events.groupBy("job_id").agg(
        *_current_aggregates(),
        F.min("event_time").alias("created_at"),
        F.min(F.when(kind.isin(START_EVENTS), F.col("event_time"))).alias("started_at"),
        F.max(F.when(kind.isin(FINISH_EVENTS), F.col("event_time"))).alias("_finished"),
    )
    status = F.col("_newest.job_status")
    is_terminal = F.upper(F.trim(status)).isin(TERMINAL_STATUSES)
    return grouped.select(
        "job_id",
        status.alias("job_status"),
        F.col("_newest.event_type").alias("last_event_type"),
        "updated_at",
        "events_count",
        "created_at",
        "started_at",
        F.coalesce("_finished", F.when(is_terminal, F.col("updated_at"))).alias("finished_at"),
    )


def job_elapsed(job_events: DataFrame, as_of: Column) -> DataFrame:
    """Milliseconds from the first JOB_CREATED (else the first event) to ``as_of``."""
    grouped = job_events.groupBy("job_id").agg(
        F.min(F.when(F.col("event_type") == "JOB_CREATED", F.col("event_time"))).alias("_created"),
        F.min("event_time").alias("_first"),
    )
    start = F.coalesce("_created", "_first")
    return grouped.select(
        "job_id",
        start.alias("started_from"),
        F.greatest(micros_between(start, as_of) / F.lit(1000), F.lit(0)).cast("long").alias("elapsed_ms"),
    )


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from ``start`` to ``end`` (both in the session zone)."""
    return F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))


def timeline(events: DataFrame, limit: int, job_id: str | None = None) -> DataFrame:
    """Events oldest first: one job's, or the first ``limit`` of every job."""
    order = [F.asc("event_time"), F.asc("event_id")]
    if job_id is not None:
        return newest_first(events.filter(F.col("job_id") == job_id), limit, *order)
    position = F.row_number().over(Window.partitionBy("job_id").orderBy(*order))
    return events.withColumn("position", position).filter(F.col("position") <= limit)


def one_shape(events: DataFrame, scope: str) -> DataFrame:
    """Job or node events in the common shape; ``scope`` is JOB or NODE."""
    node = scope == "NODE"
    return events.select(
        "event_id",
        F.lit("summary").alias("service"),
        F.lit(scope).alias("scope"),
        "job_id",
        (F.col("node_id") if node else F.lit("")).alias("node_id"),
        "event_time",
        "event_type",
        F.col("node_status" if node else "job_status").alias("status"),
        "actor",
        "message",
        "payload",
        (F.col("node_type") if node else F.lit("")).alias("node_type"),
        (F.col("level") if node else F.lit(0)).cast("int").alias("level"),
        (F.col("node_index") if node else F.lit(0)).cast("int").alias("node_index"),
    )


def recent_events(job_events: DataFrame, node_events: DataFrame, limit: int = 200) -> DataFrame:
    """Newest events of both logs."""
    both = one_shape(job_events, "JOB").unionByName(one_shape(node_events, "NODE"))
    return newest_first(both, limit, F.desc("event_time"), F.desc("event_id"), F.desc("scope"))


def staged_uploads(job_events: DataFrame, limit: int = 200, files: DataFrame | None = None) -> DataFrame:
    """Newest staged files with the current status of their job.

    The limit comes before reused and unreadable entries are dropped, so fewer rows
    may come back. ``files`` (a listing with ``path``) tells which files still exist.
    """
    newest = newest_first(
        job_events.filter(F.col("event_type") == "FILE_STAGED"), limit, F.desc("event_time"), F.desc("event_id")
    )
    payload = F.col("payload")
    keys = F.json_object_keys(payload)
    kept = newest.filter(keys.isNotNull() & ~F.array_contains(keys, "reused_upload"))

    def text(path: str) -> Column:
        return F.coalesce(F.get_json_object(payload, path), F.lit(""))

    staged = kept.select(
        F.col("job_id").alias("upload_id"),
        F.col("job_id").alias("source_job_id"),
        text("$.source.filename").alias("filename"),
        text("$.source.format").alias("source_format"),
        text("$.source.content_type").alias("content_type"),
        text("$.source.raw_line_column").alias("raw_line_column"),
        F.coalesce(F.get_json_object(payload, "$.staging.size_bytes").try_cast("long"), F.lit(0)).alias("size_bytes"),
        text("$.staging.path").alias("path"),
        F.col("event_time").alias("staged_at"),
    )
    status = job_current(job_events).select(F.col("job_id").alias("source_job_id"), "job_status")
    joined = staged.join(status, "source_job_id", "left")
    if files is not None:
        present = files.select("path").distinct().withColumn("available", F.lit(True))
        joined = joined.join(present, "path", "left").withColumn("available", F.coalesce("available", F.lit(False)))
    return joined.orderBy(F.desc("staged_at"), F.desc("upload_id"))


def changed_snapshots(snapshots: DataFrame, key: str, order: list[str], content: str) -> DataFrame:
    """Snapshots whose content differs from the previous one of the same key."""
    hashed = snapshots.withColumn("snapshot_hash", F.sha2(F.col(content), 256))
    paired = with_previous(hashed, key, order, {"previous_hash": F.col("snapshot_hash")})
    same = F.col("previous_hash") == F.col("snapshot_hash")
    return paired.filter(F.col("previous_hash").isNull() | ~same)
