"""Streams over the given tables, run to the end of their input and then read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from logweir.catalog.event_queries import JOB_CURRENT, NODE_CURRENT
from logweir.catalog.file_queries import work_folder, write_lines
from logweir.catalog.fixtures import ARTIFACTS, JOB_EVENTS, NODE_EVENTS, Tables
from logweir.catalog.registry import query
from logweir.operators.nodes import Timeouts
from logweir.sources import commits
from logweir.streaming import ingest, results, stale, state


def events_stream(t: Tables, columns: list[str]):
    # A pattern, since a file stream takes a folder or a pattern but no single file.
    source = t.spark.readStream.schema(t.read("events").schema).parquet(f"{t.folder}/[e]vents.parquet")
    return source.selectExpr(*columns)


def finish(writer: DataStreamWriter, folder: str) -> None:
    """Run a stream until its present input is used up."""
    started = writer.option("checkpointLocation", f"{folder}/checkpoint-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    started.awaitTermination()


@query("st1_stream_job_state", "job_events", JOB_CURRENT + " SELECT * FROM job_current")
def st1(t: Tables):
    folder = work_folder(t)
    finish(state.stream_current_state(events_stream(t, JOB_EVENTS), f"{folder}/state"), folder)
    return state.read_current_state(t.spark, f"{folder}/state")


@query("st1_stream_node_state", "node_events", NODE_CURRENT + " SELECT * FROM node_current")
def st1_nodes(t: Tables):
    folder = work_folder(t)
    writer = state.stream_current_state(events_stream(t, NODE_EVENTS), f"{folder}/state", state.NODE_KEYS, state.NODE_VALUES)
    finish(writer, folder)
    return state.read_current_state(t.spark, f"{folder}/state", state.NODE_KEYS, state.NODE_VALUES)


@query(
    "st2_stream_recent_events",
    "job_events node_events",
    """ SELECT * FROM (
      SELECT event_id, 'summary' AS service, 'JOB' AS scope, job_id, '' AS node_id, event_time, event_type, job_status AS status,
        actor, message, payload, '' AS node_type, 0 AS level, 0 AS node_index FROM job_events
      UNION ALL
      SELECT event_id, 'summary', 'NODE', job_id, node_id, event_time, event_type, node_status, actor, message, payload,
        node_type, level, node_index FROM node_events)
    ORDER BY event_time DESC, event_id DESC, scope DESC LIMIT 200""",
)
def st2(t: Tables):
    folder = work_folder(t)
    writer = state.stream_recent_events(events_stream(t, JOB_EVENTS), events_stream(t, NODE_EVENTS), f"{folder}/recent", 200)
    finish(writer, folder)
    return state.read_recent_events(t.spark, f"{folder}/recent")


TIMEOUTS = Timeouts(queue_seconds=86_400.0, call_seconds=172_800.0, provider_retry_seconds=259_200.0)


@query(
    "st3_stream_stale_nodes",
    "node_events",
    NODE_CURRENT
    + """, deadlines AS (SELECT *, (epoch_us(updated_at) // 1000) + CASE node_status WHEN 'RUNNING' THEN 172920000 WHEN 'QUEUED' THEN 86400000
        WHEN 'WAITING_PROVIDER' THEN 259200000 END AS deadline FROM node_current)
    SELECT job_id, node_id, node_status, (epoch_us(updated_at) // 1000) AS updated_millis, deadline AS stale_millis FROM deadlines
    WHERE deadline < (SELECT max(epoch_us(event_time) // 1000) FROM node_events)""",
)
def st3(t: Tables):
    folder = work_folder(t)
    finish(stale.stream_stale_nodes(events_stream(t, NODE_EVENTS), f"{folder}/stale", "0 seconds", TIMEOUTS), folder)
    return stale.read_stale_nodes(t.spark, f"{folder}/stale").select(
        "job_id", "node_id", "node_status",
        F.unix_millis("updated_at").alias("updated_millis"), F.unix_millis("stale_at").alias("stale_millis"),
    )


@query("st4_stream_dedupe", "artifacts", " SELECT DISTINCT job_id, node_id, content_hash FROM artifacts")
def st4(t: Tables):
    folder = work_folder(t)
    unique = results.stream_dedupe(events_stream(t, ARTIFACTS), "40 days")
    finish(unique.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/unique"), folder)
    return t.spark.read.parquet(f"{folder}/unique").select("job_id", "node_id", "content_hash")


@query(
    "st5_stream_discard_late",
    "job_events node_events artifacts",
    JOB_CURRENT
    + NODE_CURRENT
    + """ SELECT a.artifact_id, job_status, node_status, CASE
      WHEN job_status IN ('DONE', 'FAILED') THEN 'job_not_runnable' WHEN node_status <> 'RUNNING' THEN 'node_status_changed' END AS discard_reason
    FROM artifacts a LEFT JOIN job_current j ON j.job_id = a.job_id
      LEFT JOIN node_current n ON n.job_id = a.job_id AND n.node_id = a.node_id""",
)
def st5(t: Tables):
    folder = work_folder(t)
    finish(state.stream_current_state(events_stream(t, JOB_EVENTS), f"{folder}/jobs"), folder)
    nodes = state.stream_current_state(events_stream(t, NODE_EVENTS), f"{folder}/nodes", state.NODE_KEYS, state.NODE_VALUES)
    finish(nodes, folder)
    writer = results.stream_discard_late_by_state(events_stream(t, ARTIFACTS), f"{folder}/jobs", f"{folder}/nodes", f"{folder}/judged")
    finish(writer, folder)
    judged = t.spark.read.option("basePath", f"{folder}/judged").parquet(f"{folder}/judged")
    return judged.select("artifact_id", "job_status", "node_status", "discard_reason")


@query(
    "st4_stream_changed",
    "job_events",
    """, hashed AS (SELECT *, sha256(job_status) AS snapshot_hash,
        lag(sha256(job_status)) OVER (PARTITION BY job_id ORDER BY event_time, event_id) AS previous_hash FROM job_events)
    SELECT * FROM hashed WHERE previous_hash IS NULL OR previous_hash <> snapshot_hash""",
)
def st4_changed(t: Tables):
    folder = work_folder(t)
    finish(results.stream_changed(events_stream(t, JOB_EVENTS), folder, "job_id", ["event_time", "event_id"], "job_status"), folder)
    return results.read_changed(t.spark, folder)


def ingested(t: Tables) -> str:
    """Files of the events, one kind each, brought in by a stream; the folder of its tables is ``tables``."""
    folder = work_folder(t)
    lines = t.read("events").select(F.col("event_type").alias("kind"), F.concat_ws(" ", "event_type", "props").alias("value"))
    write_lines(lines, f"{folder}/staged", "kind")
    finish(ingest.stream_ingest(t.spark, f"{folder}/staged/*/*.txt", f"{folder}/tables", budget=256), folder)
    return folder


@query(
    "st6_stream_ingest",
    "",
    """SELECT event_type AS kind, count(*) AS rows_count, CAST(sum(length(event_type || ' ' || props)) AS BIGINT) AS text_chars FROM events GROUP BY event_type""",
)
def st6(t: Tables):
    folder = ingested(t)
    segments = t.spark.read.parquet(f"{folder}/tables/input_segments")
    kind = F.substring_index("content", " ", 1)
    return segments.groupBy(kind.alias("kind")).agg(
        F.sum("rows_count").alias("rows_count"),
        (F.sum("chars") - F.sum(F.col("rows_count") - 1)).alias("text_chars"),
    )


@query(
    "st6_ingest_progress",
    "",
    """SELECT event_type AS kind, count(*) AS rows_seen, true AS all_inserted, true AS in_order FROM events GROUP BY event_type""",
)
def st6_progress(t: Tables):
    """The last progress of each ingest against the rows of its file, after the batch has been replayed."""
    folder = ingested(t)
    root = f"{folder}/tables"
    again = t.spark.read.format("binaryFile").load(f"{folder}/staged/*/*.txt").select("path")
    ingest.ingest_batch(again.withColumn("job_id", F.concat(F.lit("job_"), F.substring(F.sha2("path", 256), 1, 32))), root, 256)
    events, segments = commits.read_table(t.spark, root, "job_events"), commits.read_table(t.spark, root, "input_segments")
    told = F.from_json("payload", "segments_seen long, rows_seen long, inserted_segments long")
    steps = events.where("event_type = 'INPUT_INGEST_PROGRESS'").select("job_id", "event_time", told.alias("p"))
    last = steps.groupBy("job_id").agg(
        F.max("p.rows_seen").alias("rows_seen"), F.max("p.inserted_segments").alias("inserted"),
        (F.max_by("p.rows_seen", "event_time") == F.max("p.rows_seen")).alias("in_order"),
    )
    kinds = segments.groupBy("job_id").agg(F.min(F.substring_index("content", " ", 1)).alias("kind"), F.count("*").alias("segments"))
    joined = last.join(kinds, "job_id")
    return joined.groupBy("kind").agg(
        F.sum("rows_seen").alias("rows_seen"), F.bool_and(F.col("inserted") == F.col("segments")).alias("all_inserted"), F.bool_and("in_order").alias("in_order")
    )
