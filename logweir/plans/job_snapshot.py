"""The composite read model of jobs: one row per job, and its detail tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.operators import artifacts as art
from logweir.operators import jobs, nodes, segments


def job_snapshots(
    job_events: DataFrame, node_events: DataFrame, artifacts: DataFrame, input_segments: DataFrame
) -> DataFrame:
    """Lifecycle, progress, input statistics and final artifact of every job.

    Lists (nodes, links, events) stay in tables of their own, see
    :func:`snapshot_details`: nested into one row they would grow without bound.
    """
    final = art.latest_artifacts(artifacts, ["job_id"], artifact_type="FINAL_SUMMARY").select(
        "job_id",
        F.col("artifact_id").alias("final_artifact_id"),
        F.col("content").alias("final_content"),
    )
    counted = artifacts.groupBy("job_id").agg(F.count("*").alias("artifacts_count"))
    stats = segments.input_stats(segments.latest_segments(input_segments, columns=["rows_count", "chars"]))
    counts = [
        "nodes_done",
        "nodes_total",
        "progress_percent",
        "artifacts_count",
        "segments_count",
        "rows_count",
        "chars",
        "estimated_tokens",
    ]
    joined = jobs.job_lifecycle(job_events)
    for part in (nodes.job_progress(nodes.node_current(node_events)), counted, final, stats):
        joined = joined.join(part, "job_id", "left")
    return joined.fillna(0, subset=counts)


def snapshot_details(
    job_id: str, job_events: DataFrame, node_events: DataFrame, artifacts: DataFrame
) -> dict[str, DataFrame]:
    """The lists of one job's snapshot; the job filter reaches every scan."""
    own = {
        name: table.filter(F.col("job_id") == job_id)
        for name, table in {"jobs": job_events, "nodes": node_events, "artifacts": artifacts}.items()
    }
    current = nodes.node_current(own["nodes"])
    return {
        "nodes": current.orderBy("level", "node_type", "node_index", "node_id"),
        "node_counts": nodes.status_counts(current),
        "artifact_counts": nodes.artifact_counts(own["artifacts"]),
        "node_links": nodes.node_links(current, nodes.node_payload(own["nodes"])).orderBy(*nodes.LINK_ORDER),
        "artifacts": art.list_artifacts(own["artifacts"]),
        "job_events": jobs.timeline(own["jobs"], 200, job_id),
        "node_events": jobs.timeline(own["nodes"], 500, job_id),
    }


ENTRY = {
    "item_id": "string", "name": "string", "status": "string", "level": "int", "item_index": "int", "counted": "long", "position": "int",
}


def snapshot_entries(
    job_events: DataFrame, node_events: DataFrame, artifacts: DataFrame, job_limit: int = 200, node_limit: int = 500
) -> DataFrame:
    """The lists of all jobs' snapshots as one long table: ``job_id, list`` and the fields of an entry.

    Lists are ordered by (level, name, item_index, item_id), those of events by their ``position``
    among the first of their job. Nothing of a job is gathered: counts are partial aggregates,
    the limits on events are applied before their shuffle.
    """
    current = nodes.node_current(node_events)
    links = nodes.node_links(current, nodes.node_payload(node_events))

    def entries(listed: str, rows: DataFrame, **fields: str) -> DataFrame:
        filled = [(F.col(fields[key]) if key in fields else F.lit(None)).cast(kind).alias(key) for key, kind in ENTRY.items()]
        return rows.select("job_id", F.lit(listed).alias("list"), *filled)

    parts = [
        entries("nodes", current, item_id="node_id", name="node_type", status="node_status", level="level", item_index="node_index"),
        entries("node_counts", nodes.status_counts(current), name="node_status", counted="nodes_count"),
        entries("artifact_counts", nodes.artifact_counts(artifacts), name="artifact_type", counted="artifacts_count"),
        entries("node_links", links, item_id="from_node_id", name="to_node_id", status="from_node_type", level="level", item_index="input_index"),
        entries("artifacts", artifacts, item_id="artifact_id", name="artifact_type", status="stage", level="level"),
        entries("job_events", jobs.timeline(job_events, job_limit), item_id="event_id", name="event_type", status="job_status", position="position"),
        entries("node_events", jobs.timeline(node_events, node_limit), item_id="event_id", name="event_type", status="node_status", position="position"),
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table
