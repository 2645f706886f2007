"""Appending to the state tables.

Events, artifacts and snapshots are only ever appended. A table folder is Parquet,
rows sorted by its key inside each file, so that row-group statistics can skip. An append with
a ``commit`` key can be done again without adding anything (:mod:`logweir.sources.commits`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from logweir.functions.ids import content_hash, hash_or_empty
from logweir.functions.scalars import sorted_json
from logweir.sources import commits

# Sort keys and version columns of the state tables.
SORT_KEYS = {
    "job_events": ["job_id", "event_time", "event_id"],
    "node_events": ["job_id", "node_type", "level", "node_index", "node_id", "event_time", "event_id"],
    "artifacts": ["job_id", "stage", "level", "node_id", "artifact_type", "created_at", "artifact_id"],
    "input_segments": ["job_id", "segment_index"],
    "llm_calls": ["job_id", "node_id", "created_at", "call_id"],
    "monitoring_profiles": ["profile_id", "updated_at", "snapshot_id"],
    "monitoring_schedules": ["profile_id", "updated_at", "snapshot_id"],
    "monitoring_runs": ["profile_id", "run_id", "updated_at", "snapshot_id"],
}


def append(df: DataFrame, root: str, table: str, commit: str | None = None) -> None:
    """Append rows to a state table under ``root``."""
    commits.put(df, root, table, SORT_KEYS[table], commit)


def _row_hash(*columns: str | Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 32)


def append_events(events: DataFrame, root: str, table: str, commit: str | None = None) -> None:
    """Append job or node events; a map payload becomes JSON with sorted keys.

    Without an ``event_id`` one is derived from the row, so a replay writes the same id.
    """
    if str(events.schema["payload"].dataType.typeName()) == "map":
        empty = F.create_map().cast("map<string,string>")
        events = events.withColumn("payload", sorted_json(F.coalesce("payload", empty)))
    events = events.withColumn("payload", F.coalesce("payload", F.lit("{}")))
    if "event_id" not in events.columns:
        events = events.withColumn("event_id", _row_hash(*events.columns))
    append(events, root, table, commit)


def artifact_rows(artifacts: DataFrame, created_at: Column, *keep: str) -> DataFrame:
    """Artifacts with content hash, creation time and an id derived from both."""
    hashed = artifacts.withColumn("content_hash", content_hash(F.col("content"))).withColumn("created_at", created_at)
    identity = _row_hash("job_id", "node_id", "artifact_type", "content_hash", "created_at")
    return hashed.select(
        *keep, identity.alias("artifact_id"), "job_id", "node_id", "artifact_type", "stage", "level",
        "content_hash", "content", "metadata", "created_at",
    )


def append_artifacts(artifacts: DataFrame, root: str, created_at: Column, *keep: str, commit: str | None = None) -> None:
    append(artifact_rows(artifacts, created_at, *keep), root, "artifacts", commit)


def append_segments(segments: DataFrame, root: str, created_at: Column, commit: str | None = None) -> dict[str, int]:
    """Append segments and return how many segments and rows were written."""
    totals = Observation("segments")
    rows = segments.withColumn("created_at", created_at).observe(
        totals, F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("rows_count"), F.lit(0)).alias("rows")
    )
    append(rows, root, "input_segments", commit)
    return dict(totals.get)


def llm_call_rows(calls: DataFrame) -> DataFrame:
    """Calls with the hashes of request and response; an empty text has an empty hash."""
    return calls.withColumns(
        {
            "request_hash": hash_or_empty(F.col("request_json")),
            "response_hash": hash_or_empty(F.col("response_json")),
        }
    )


def append_llm_calls(calls: DataFrame, root: str, commit: str | None = None) -> None:
    append(llm_call_rows(calls), root, "llm_calls", commit)


SNAPSHOT_TABLES = {"profile": "monitoring_profiles", "schedule": "monitoring_schedules", "run": "monitoring_runs"}


def append_snapshots(snapshots: DataFrame, root: str, kind: str, commit: str | None = None) -> None:
    """Append new versions of profiles, schedules or runs."""
    if "snapshot_id" not in snapshots.columns:
        snapshots = snapshots.withColumn("snapshot_id", _row_hash(*snapshots.columns))
    append(snapshots, root, SNAPSHOT_TABLES[kind], commit)
