"""Queries over the event, artifact, segment and call tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.catalog.fixtures import Tables
from logweir.catalog.registry import query
from logweir.functions.scalars import classify_error
from logweir.operators import artifacts as art
from logweir.operators import calls, jobs, nodes, segments
from logweir.sources.segments import resume_ingest

AS_OF = "2024-01-31 00:00:00"
TIMEOUTS = nodes.Timeouts(queue_seconds=86_400.0, call_seconds=172_800.0, provider_retry_seconds=259_200.0)


def instant(text: str):
    return F.lit(text).cast("timestamp_ntz")


JOB_CURRENT_SQL = """, job_current AS (
  SELECT e.job_id, job_status, event_type AS last_event_type, event_time AS updated_at, n AS events_count
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY event_time DESC, event_id DESC) AS r,
          count(*) OVER (PARTITION BY job_id) AS n FROM {events}) e WHERE r = 1)"""
JOB_CURRENT = JOB_CURRENT_SQL.format(events="job_events")
NODE_CURRENT = """, node_current AS (
  SELECT job_id, node_id, node_type, level, node_index, node_status, event_type AS last_event_type, event_time AS updated_at, n AS events_count
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id, node_id ORDER BY event_time DESC, event_id DESC) AS r,
          count(*) OVER (PARTITION BY job_id, node_id) AS n FROM node_events) e WHERE r = 1)"""
EXPIRED = """CASE node_status WHEN 'RUNNING' THEN age >= 172920 WHEN 'QUEUED' THEN age >= 86400
  WHEN 'WAITING_PROVIDER' THEN age >= 259200 ELSE false END"""
AGED = f""", aged AS (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(updated_at)) / 1000000.0 AS age FROM node_current)
, judged AS (SELECT *, {EXPIRED} AS expired FROM aged)"""


@query("e1_job_current", "job_events", JOB_CURRENT + " SELECT * FROM job_current")
def e1(t: Tables):
    return jobs.job_current(t.job_events)


@query("e2_node_current", "node_events", NODE_CURRENT + " SELECT * FROM node_current")
def e2(t: Tables):
    return nodes.node_current(t.node_events)


@query(
    "e3_list_jobs",
    "job_events",
    JOB_CURRENT + " SELECT * FROM job_current WHERE job_status = 'RUNNING' ORDER BY updated_at DESC, job_id LIMIT 20",
)
def e3(t: Tables):
    return jobs.list_jobs(t.job_events, status="RUNNING", limit=20)


@query(
    "e4_latest_segments",
    "segments",
    """ SELECT * FROM segments
    QUALIFY row_number() OVER (PARTITION BY job_id, segment_index ORDER BY created_at DESC, content_hash DESC) = 1""",
)
def e4(t: Tables):
    return segments.latest_segments(t.segments)


@query(
    "e5_latest_artifact",
    "artifacts",
    """ SELECT * FROM artifacts WHERE stage = 'REDUCE'
    QUALIFY row_number() OVER (PARTITION BY job_id, node_id, artifact_type ORDER BY created_at DESC, artifact_id DESC) = 1""",
)
def e5(t: Tables):
    return art.latest_artifacts(t.artifacts, stage="REDUCE")


@query(
    "e6_list_artifacts",
    "artifacts",
    " SELECT * EXCLUDE (content) FROM artifacts WHERE artifact_type = 'REDUCE_SUMMARY' AND level = 1",
)
def e6(t: Tables):
    return art.list_artifacts(t.artifacts, artifact_type="REDUCE_SUMMARY", level=1)


@query(
    "e7_latest_llm_call",
    "llm_calls",
    """ SELECT * FROM llm_calls
    QUALIFY row_number() OVER (PARTITION BY job_id, node_id ORDER BY created_at DESC, call_id DESC) = 1""",
)
def e7(t: Tables):
    return calls.latest_calls(t.llm_calls)


@query(
    "e8_node_payload",
    "node_events",
    """ SELECT job_id, node_id, payload FROM node_events WHERE payload NOT IN ('', '{}')
    QUALIFY row_number() OVER (PARTITION BY job_id, node_id ORDER BY
      CASE WHEN contains(payload, '"input_node_ids"') THEN 3 WHEN contains(payload, '"chunk_hash"') THEN 2 ELSE 0 END DESC,
      event_time DESC, event_id DESC) = 1""",
)
def e8(t: Tables):
    return nodes.node_payload(t.node_events)


@query(
    "e9_job_timeline",
    "job_events",
    """ SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY event_time, event_id) AS INT) AS position FROM job_events)
    WHERE position <= 25""",
)
def e9(t: Tables):
    return jobs.timeline(t.job_events, limit=25)


@query(
    "e9_node_timeline",
    "node_events",
    """ SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY event_time, event_id) AS INT) AS position FROM node_events)
    WHERE position <= 40""",
)
def e9_nodes(t: Tables):
    return jobs.timeline(t.node_events, limit=40)


@query(
    "e10_recent_events",
    "job_events node_events",
    """ SELECT * FROM (
      SELECT event_id, 'summary' AS service, 'JOB' AS scope, job_id, '' AS node_id, event_time, event_type, job_status AS status,
        actor, message, payload, '' AS node_type, 0 AS level, 0 AS node_index FROM job_events
      UNION ALL
      SELECT event_id, 'summary', 'NODE', job_id, node_id, event_time, event_type, node_status, actor, message, payload,
        node_type, level, node_index FROM node_events)
    ORDER BY event_time DESC, event_id DESC, scope DESC LIMIT 200""",
)
def e10(t: Tables):
    return jobs.recent_events(t.job_events, t.node_events, limit=200)


LIFECYCLE = JOB_CURRENT + """, times AS (
  SELECT job_id, min(event_time) AS created_at,
    min(event_time) FILTER (event_type IN ('INPUT_INGEST_STARTED', 'JOB_RUNNING', 'JOB_RESUMED')) AS started_at,
    max(event_time) FILTER (event_type IN ('JOB_DONE', 'JOB_FAILED', 'JOB_CANCELLED')) AS finish
  FROM job_events GROUP BY job_id)
, lifecycle AS (SELECT c.*, created_at, started_at,
    coalesce(finish, CASE WHEN job_status IN ('DONE', 'FAILED', 'CANCELLED') THEN updated_at END) AS finished_at
  FROM job_current c JOIN times USING (job_id))"""


@query("e11_job_lifecycle", "job_events", LIFECYCLE + " SELECT * FROM lifecycle")
def e11(t: Tables):
    return jobs.job_lifecycle(t.job_events)


@query(
    "e12_status_counts",
    "node_events",
    NODE_CURRENT + " SELECT job_id, node_status, count(*) AS nodes_count FROM node_current GROUP BY ALL",
)
def e12(t: Tables):
    return nodes.status_counts(nodes.node_current(t.node_events))


@query(
    "e12_artifact_counts",
    "artifacts",
    " SELECT job_id, artifact_type, count(*) AS artifacts_count FROM artifacts GROUP BY ALL",
)
def e12_artifacts(t: Tables):
    return nodes.artifact_counts(t.artifacts)


@query(
    "e13_job_progress",
    "node_events",
    NODE_CURRENT
    + """ SELECT job_id, count(*) FILTER (node_status = 'DONE') AS nodes_done, count(*) AS nodes_total,
      CAST(floor(count(*) FILTER (node_status = 'DONE') / count(*) * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS progress_percent
    FROM node_current GROUP BY job_id""",
)
def e13(t: Tables):
    return nodes.job_progress(nodes.node_current(t.node_events))


@query(
    "e14_stage_progress",
    "job_events node_events artifacts",
    JOB_CURRENT
    + NODE_CURRENT
    + """, maps AS (SELECT job_id, count(*) AS map_nodes, count(*) FILTER (node_status = 'DONE') AS map_done
      FROM node_current WHERE node_type = 'MAP' GROUP BY job_id)
    , top AS (SELECT job_id, max(level) AS reduce_level FROM node_current WHERE node_type = 'REDUCE' GROUP BY job_id)
    , top_nodes AS (SELECT n.job_id, bool_and(node_status = 'DONE') AS all_done, any_value(reduce_level) AS reduce_level
      FROM node_current n JOIN top USING (job_id) WHERE node_type = 'REDUCE' AND level = reduce_level GROUP BY n.job_id)
    , left_over AS (SELECT t.job_id, count(a.artifact_id) AS outs FROM top t LEFT JOIN artifacts a
      ON a.job_id = t.job_id AND a.artifact_type = 'REDUCE_SUMMARY' AND a.level = t.reduce_level GROUP BY t.job_id)
    , map_outs AS (SELECT job_id, count(*) AS outs FROM artifacts WHERE artifact_type = 'MAP_SUMMARY' GROUP BY job_id)
    , finals AS (SELECT DISTINCT job_id, true AS has_final FROM artifacts WHERE artifact_type = 'FINAL_SUMMARY')
    , facts AS (SELECT c.job_id, job_status, coalesce(map_nodes, 0) AS map_nodes, coalesce(map_done, 0) AS map_done,
        CAST(coalesce(t.reduce_level, 0) AS INT) AS reduce_level, coalesce(all_done, false) AS all_done,
        CASE WHEN t.reduce_level > 0 THEN coalesce(l.outs, 0) ELSE coalesce(m.outs, 0) END AS outputs_left, has_final
      FROM job_current c LEFT JOIN maps USING (job_id) LEFT JOIN top_nodes t USING (job_id)
        LEFT JOIN left_over l USING (job_id) LEFT JOIN map_outs m USING (job_id) LEFT JOIN finals USING (job_id)
      WHERE job_status NOT IN ('PAUSED', 'INGESTING', 'PAUSE_REQUESTED', 'CANCEL_REQUESTED', 'CANCELLED', 'DONE', 'FAILED'))
    SELECT job_id, job_status, map_nodes, map_done, reduce_level, outputs_left,
      CASE WHEN map_nodes + reduce_level = 0 THEN 'map' WHEN map_nodes = 0 OR map_done < map_nodes THEN 'wait_map'
        WHEN reduce_level > 0 AND NOT all_done THEN 'wait_reduce' WHEN outputs_left > 1 THEN 'reduce'
        WHEN has_final THEN 'done' ELSE 'final' END AS next_step
    FROM facts""",
)
def e14(t: Tables):
    return nodes.stage_progress(t.job_events, nodes.node_current(t.node_events), t.artifacts)


@query(
    "e15_recoverable_jobs",
    "job_events",
    JOB_CURRENT
    + """ SELECT *, CASE WHEN job_status = 'INGESTING' THEN 'ingest' ELSE 'advance' END AS action FROM job_current
    WHERE job_status IN ('CREATED', 'INGESTING', 'INPUT_READY', 'RUNNING', 'RESUMED', 'WAITING_RETRY', 'WAITING_PROVIDER')""",
)
def e15(t: Tables):
    return jobs.recoverable_jobs(t.job_events)


@query(
    "e16_stale_nodes",
    "node_events",
    NODE_CURRENT + AGED + " SELECT * EXCLUDE (age, expired), CAST(floor(age) AS BIGINT) AS age_seconds FROM judged WHERE expired",
)
def e16(t: Tables):
    return nodes.stale_nodes(nodes.node_current(t.node_events), instant(AS_OF), TIMEOUTS)


@query(
    "e17_dispatch_backlog",
    "node_events",
    NODE_CURRENT
    + AGED
    + """, flags AS (SELECT *, node_status IN ('PENDING', 'WAITING_RETRY') OR expired AS ready,
        node_status IN ('RUNNING', 'QUEUED', 'WAITING_PROVIDER') AND NOT expired AS active
      FROM judged WHERE node_type IN ('MAP', 'REDUCE'))
    , sums AS (SELECT job_id, node_type, count(*) FILTER (ready) AS ready_nodes, count(*) FILTER (active) AS active_nodes FROM flags GROUP BY ALL)
    , slots AS (SELECT *, CAST(5 AS BIGINT) AS dispatch_limit, greatest(0, 5 - active_nodes) AS free_slots FROM sums)
    SELECT f.job_id, f.node_type, node_id, node_index, level,
      CAST(row_number() OVER (PARTITION BY f.job_id, f.node_type ORDER BY level, node_index, node_id) AS INT) AS position,
      ready_nodes, active_nodes, dispatch_limit, free_slots
    FROM flags f JOIN slots s ON s.job_id = f.job_id AND s.node_type = f.node_type WHERE ready
    QUALIFY position <= free_slots""",
)
def e17(t: Tables):
    return nodes.dispatch_backlog(nodes.node_current(t.node_events), instant(AS_OF), TIMEOUTS)


@query(
    "e18_job_elapsed",
    "job_events",
    f""", starts AS (SELECT job_id, coalesce(min(event_time) FILTER (event_type = 'JOB_CREATED'), min(event_time)) AS started_from
      FROM job_events GROUP BY job_id)
    SELECT job_id, started_from,
      greatest(0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(started_from)) // 1000) AS elapsed_ms FROM starts""",
)
def e18(t: Tables):
    return jobs.job_elapsed(t.job_events, instant(AS_OF))


LATEST_CALLS = """, calls AS (
  SELECT *, latency_ms AS eff, CASE WHEN provider_latency_ms <= 0 AND latency_ms > 0 THEN greatest(0, latency_ms - pool_wait_ms) ELSE provider_latency_ms END AS prov,
    CASE WHEN error_message <> '' THEN 'E' ELSE '' END AS error_class
  FROM llm_calls QUALIFY row_number() OVER (PARTITION BY job_id, node_id ORDER BY created_at DESC, call_id DESC) = 1)"""


def _speed(tokens: str, millis: str) -> str:
    return (
        f"CASE WHEN {millis} > 0 THEN CASE WHEN {tokens} > 0 THEN round({tokens} / ({millis} / 1000.0::DOUBLE), 2) ELSE 0 END END"
    )


def _with_class(t: Tables):
    return t.llm_calls.withColumn("error_class", F.when(F.col("error_message") != "", "E").otherwise(""))


@query(
    "e19_llm_telemetry",
    "llm_calls",
    LATEST_CALLS
    + f""" SELECT job_id, node_id, provider, model, status, error_class, left(error_message, 2000) AS error_message,
      latency_ms, pool_wait_ms, prov AS provider_latency_ms, prompt_tokens, completion_tokens, total_tokens, eff AS effective_latency_ms,
      {_speed('completion_tokens', 'prov')} AS completion_tokens_per_second, {_speed('total_tokens', 'prov')} AS total_tokens_per_second,
      {_speed('completion_tokens', 'eff')} AS effective_completion_tokens_per_second,
      {_speed('total_tokens', 'eff')} AS effective_total_tokens_per_second FROM calls""",
)
def e19(t: Tables):
    return calls.llm_telemetry(_with_class(t))


@query(
    "e19_telemetry_rollup",
    "llm_calls",
    LATEST_CALLS
    + """ SELECT provider, model, error_class, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
      CAST(sum(prov) AS BIGINT) AS provider_latency_ms, max(eff) AS max_latency_ms FROM calls GROUP BY provider, model, error_class""",
)
def e19_rollup(t: Tables):
    return calls.telemetry_rollup(calls.llm_telemetry(_with_class(t)))


WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def duck_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


@query(
    "e20_call_messages",
    "turn_calls",
    f" SELECT call_id, job_id, node_id, 1 AS position, CASE WHEN role = '' THEN 'message' ELSE role END AS role, "
    f"{duck_strip('text')} AS content FROM turn_calls WHERE {duck_strip('text')} <> ''",
)
def e20(t: Tables):
    return calls.call_messages(t.turn_calls)


@query(
    "e20_assistant_messages",
    "turn_calls",
    f" SELECT call_id, job_id, node_id, {duck_strip('text')} AS assistant_message FROM turn_calls",
)
def e20_assistant(t: Tables):
    return calls.assistant_messages(t.turn_calls)


OUTPUT_TYPE = "CASE node_type WHEN 'MAP' THEN 'MAP_SUMMARY' WHEN 'REDUCE' THEN 'REDUCE_SUMMARY' ELSE 'FINAL_SUMMARY' END"


@query(
    "e21_rerun_candidates",
    "node_events artifacts",
    NODE_CURRENT
    + f""" SELECT n.*, {OUTPUT_TYPE} AS artifact_type FROM node_current n WHERE NOT EXISTS (
      SELECT 1 FROM artifacts a WHERE a.job_id = n.job_id AND a.node_id = n.node_id AND a.artifact_type = {OUTPUT_TYPE})""",
)
def e21(t: Tables):
    return nodes.rerun_candidates(nodes.node_current(t.node_events), t.artifacts)


PAYLOADS = """, payloads AS (SELECT job_id, node_id, payload FROM node_events WHERE payload NOT IN ('', '{}')
    QUALIFY row_number() OVER (PARTITION BY job_id, node_id ORDER BY
      CASE WHEN contains(payload, '"input_node_ids"') THEN 3 WHEN contains(payload, '"chunk_hash"') THEN 2 ELSE 0 END DESC,
      event_time DESC, event_id DESC) = 1)"""
LINKS = """, listed AS (SELECT n.*, list_filter(list_transform(CAST(json_extract(payload, '$.input_node_ids') AS VARCHAR[]), lambda x: trim(x)), lambda x: x <> '') AS ids
      FROM node_current n JOIN payloads p ON p.job_id = n.job_id AND p.node_id = n.node_id WHERE node_type <> 'MAP')
    , edges AS (SELECT *, unnest(ids) AS from_node_id, CAST(generate_subscripts(ids, 1) - 1 AS INT) AS input_index FROM listed)
    , links AS (SELECT job_id, 'summary-source' AS from_node_id, 'SOURCE' AS from_node_type, node_id AS to_node_id, node_type AS to_node_type,
      0 AS input_index, 0 AS type_order, level, node_index FROM node_current WHERE node_type = 'MAP'
    UNION ALL
    SELECT e.job_id, e.from_node_id, coalesce(f.node_type, ''), e.node_id, e.node_type, e.input_index,
      CASE e.node_type WHEN 'REDUCE' THEN 1 ELSE 2 END, e.level, e.node_index
    FROM edges e LEFT JOIN node_current f ON f.job_id = e.job_id AND f.node_id = e.from_node_id)"""


@query(
    "e22_node_links",
    "node_events",
    NODE_CURRENT
    + PAYLOADS
    + LINKS
    + " SELECT * FROM links",
)
def e22(t: Tables):
    return nodes.node_links(nodes.node_current(t.node_events), nodes.node_payload(t.node_events))


@query(
    "e24_changed_snapshots",
    "job_events",
    """, hashed AS (SELECT *, sha256(job_status) AS snapshot_hash,
        lag(sha256(job_status)) OVER (PARTITION BY job_id ORDER BY event_time, event_id) AS previous_hash FROM job_events)
    SELECT * FROM hashed WHERE previous_hash IS NULL OR previous_hash <> snapshot_hash""",
)
def e24(t: Tables):
    return jobs.changed_snapshots(t.job_events, "job_id", ["event_time", "event_id"], "job_status")


def duck_tokens(text: str) -> str:
    return f"greatest(1, CAST(ceil(length({text}) / CAST(2.2 AS DOUBLE)) AS BIGINT))"


@query(
    "e25_audit_tokens",
    "turn_calls",
    f""", sized AS (SELECT call_id, job_id, node_id, {duck_tokens('role')} AS system_tokens, {duck_tokens('text')} AS user_tokens,
        CASE WHEN length(text) > 0 THEN {duck_tokens('text')} ELSE 0 END AS response_tokens,
        sha256(role) AS system_sha256, sha256(text) AS user_sha256 FROM turn_calls)
    SELECT *, system_tokens + user_tokens + response_tokens AS total_tokens FROM sized""",
)
def e25(t: Tables):
    turns = t.turn_calls.select(
        "*",
        F.get_json_object("request_json", "$.messages[1].role").alias("_role"),
        F.get_json_object("request_json", "$.messages[1].content").alias("_text"),
    )
    return calls.audit_tokens(turns, F.col("_role"), F.col("_text"), F.col("_text"))


@query(
    "n10_classify_error",
    "llm_calls",
    """ SELECT call_id, error_message, CASE
      WHEN error_message LIKE 'Context%' THEN 'context_too_long' WHEN error_message LIKE '%429%' THEN 'rate_limit'
      WHEN error_message LIKE '%timed out%' THEN 'timeout' WHEN error_message LIKE 'JSON%' THEN 'schema_or_json'
      ELSE 'unknown' END AS error_class FROM llm_calls""",
)
def n10(t: Tables):
    return t.llm_calls.select("call_id", "error_message", classify_error(F.col("error_message")).alias("error_class"))


@query(
    "n11_runnable_jobs",
    "job_events",
    JOB_CURRENT + " SELECT * FROM job_current WHERE job_status IN ('CREATED', 'RUNNING', 'INPUT_READY')",
)
def n11(t: Tables):
    return jobs.runnable_jobs(t.job_events)


@query(
    "s9_staged_uploads",
    "upload_events",
    JOB_CURRENT_SQL.format(events="upload_events")
    + """, newest AS (SELECT * FROM upload_events WHERE event_type = 'FILE_STAGED' ORDER BY event_time DESC, event_id DESC LIMIT 200)
    , good AS (SELECT * FROM newest WHERE payload NOT LIKE '{broken%' AND payload NOT LIKE '%"reused_upload"%')
    SELECT g.job_id AS upload_id, g.job_id AS source_job_id, json_extract_string(payload, '$.source.filename') AS filename,
      json_extract_string(payload, '$.source.format') AS source_format, json_extract_string(payload, '$.source.content_type') AS content_type,
      coalesce(json_extract_string(payload, '$.source.raw_line_column'), '') AS raw_line_column,
      CAST(json_extract_string(payload, '$.staging.size_bytes') AS BIGINT) AS size_bytes,
      json_extract_string(payload, '$.staging.path') AS path, event_time AS staged_at, c.job_status
    FROM good g LEFT JOIN job_current c ON c.job_id = g.job_id""",
)
def s9(t: Tables):
    return jobs.staged_uploads(t.upload_events, limit=200)


NEWEST_SEGMENT = """, newest AS (SELECT * FROM segments
    QUALIFY row_number() OVER (PARTITION BY job_id, segment_index ORDER BY created_at DESC, content_hash DESC) = 1)"""


@query(
    "s10_resume_ingest",
    "segments",
    NEWEST_SEGMENT
    + """, stored AS (SELECT DISTINCT job_id, segment_index FROM segments WHERE source_type = 'upload')
    SELECT n.* FROM newest n WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.job_id = n.job_id AND s.segment_index = n.segment_index)""",
)
def s10(t: Tables):
    stored = t.segments.filter(F.col("source_type") == "upload")
    return resume_ingest(segments.latest_segments(t.segments), stored)


@query(
    "c4_clone_segments",
    "segments",
    NEWEST_SEGMENT
    + """ SELECT 'rerun_' || job_id AS job_id, segment_index, CASE WHEN source_type = '' THEN 'rerun' ELSE source_type END AS source_type,
      source_format, content_hash, content, rows_count, chars,
      '{"first_timestamp":"a","last_timestamp":"b","rerun_source_job_id":"' || job_id || '","rerun_source_segment_index":"' || segment_index || '"}' AS metadata,
      created_at FROM newest""",
)
def c4(t: Tables):
    reruns = t.segments.select("job_id").distinct().withColumn("new_job_id", F.concat(F.lit("rerun_"), "job_id"))
    return segments.clone_segments(t.segments, reruns)


@query(
    "c5_input_stats",
    "segments",
    NEWEST_SEGMENT
    + """, sums AS (SELECT job_id, count(*) AS segments_count, CAST(sum(greatest(rows_count, 0)) AS BIGINT) AS rows_count,
        CAST(sum(greatest(chars, 0)) AS BIGINT) AS chars FROM newest GROUP BY job_id)
    SELECT *, CASE WHEN chars > 0 THEN CAST(ceil(chars / CAST(2.2 AS DOUBLE)) AS BIGINT) ELSE 0 END AS estimated_tokens FROM sums""",
)
def c5(t: Tables):
    return segments.input_stats(segments.latest_segments(t.segments, columns=["rows_count", "chars"]))


@query(
    "c6_count_segments",
    "segments",
    " SELECT job_id, count(DISTINCT segment_index) AS segments_count FROM segments GROUP BY job_id",
)
def c6(t: Tables):
    return segments.count_segments(t.segments)


@query(
    "c7_manifest",
    "segments",
    NEWEST_SEGMENT
    + """, sums AS (SELECT job_id, count(*) AS n, CAST(sum(rows_count) AS BIGINT) AS r, CAST(sum(chars) AS BIGINT) AS c FROM newest GROUP BY job_id)
    , texts AS (SELECT *, 'text input manifest: chars=' || c || ', rows=' || r || ', segments=' || n AS content FROM sums)
    SELECT job_id, '' AS node_id, 'INPUT' AS artifact_type, 'INPUT' AS stage, 0 AS level, content, sha256(content) AS content_hash,
      '{"manifest":{"chars":' || c || ',"rows_count":' || r || ',"segments_count":' || n || '}}' AS metadata FROM texts""",
)
def c7(t: Tables):
    return segments.manifest(segments.latest_segments(t.segments, columns=["rows_count", "chars"]))


@query(
    "m15_skip_done",
    "node_events artifacts",
    NODE_CURRENT
    + """ SELECT n.* FROM node_current n WHERE node_type = 'MAP' AND NOT EXISTS (
      SELECT 1 FROM artifacts a WHERE a.job_id = n.job_id AND a.node_id = n.node_id AND a.artifact_type = 'MAP_SUMMARY')""",
)
def m15(t: Tables):
    maps = nodes.node_current(t.node_events).filter(F.col("node_type") == "MAP")
    return art.skip_done(maps, t.artifacts, "MAP_SUMMARY")


@query(
    "m16_discard_late_results",
    "job_events node_events artifacts",
    JOB_CURRENT
    + NODE_CURRENT
    + """ SELECT a.*, job_status, node_status, CASE
      WHEN job_status IS NULL THEN 'job_missing' WHEN job_status IN ('DONE', 'FAILED') THEN 'job_not_runnable'
      WHEN node_status IS NULL THEN 'node_missing' WHEN node_status <> 'RUNNING' THEN 'node_status_changed' END AS discard_reason
    FROM artifacts a LEFT JOIN job_current j ON j.job_id = a.job_id
      LEFT JOIN node_current n ON n.job_id = a.job_id AND n.node_id = a.node_id""",
)
def m16(t: Tables):
    return art.judge_results(t.artifacts, t.job_events, t.node_events)


@query(
    "e23_job_snapshot",
    "job_events node_events artifacts segments",
    LIFECYCLE
    + NODE_CURRENT
    + NEWEST_SEGMENT
    + """, n AS (SELECT job_id, count(*) AS nodes_total, count(*) FILTER (node_status = 'DONE') AS nodes_done FROM node_current GROUP BY job_id)
    , a AS (SELECT job_id, count(*) AS artifacts_count FROM artifacts GROUP BY job_id)
    , f AS (SELECT job_id, artifact_id AS final_artifact_id, content AS final_content FROM artifacts WHERE artifact_type = 'FINAL_SUMMARY'
        QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, artifact_id DESC) = 1)
    , s AS (SELECT job_id, count(*) AS segments_count, CAST(sum(greatest(rows_count, 0)) AS BIGINT) AS rows_count,
        CAST(sum(greatest(chars, 0)) AS BIGINT) AS chars FROM newest GROUP BY job_id)
    SELECT l.*, coalesce(nodes_done, 0) AS nodes_done, coalesce(nodes_total, 0) AS nodes_total,
      CASE WHEN nodes_total > 0 THEN CAST(floor(nodes_done / nodes_total * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) ELSE 0 END AS progress_percent,
      coalesce(artifacts_count, 0) AS artifacts_count, final_artifact_id, final_content,
      coalesce(segments_count, 0) AS segments_count, coalesce(rows_count, 0) AS rows_count, coalesce(chars, 0) AS chars,
      CASE WHEN chars > 0 THEN CAST(ceil(chars / CAST(2.2 AS DOUBLE)) AS BIGINT) ELSE 0 END AS estimated_tokens
    FROM lifecycle l LEFT JOIN n USING (job_id) LEFT JOIN a USING (job_id) LEFT JOIN f USING (job_id) LEFT JOIN s USING (job_id)""",
)
def e23(t: Tables):
    from logweir.plans.job_snapshot import job_snapshots

    return job_snapshots(t.job_events, t.node_events, t.artifacts, t.segments)


FIRST_EVENTS = """SELECT job_id, '{list}', CAST(event_id AS VARCHAR), event_type, {status}, NULL, NULL, NULL, CAST(r AS INT) FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY event_time, event_id) AS r FROM {list}) WHERE r <= {limit}"""


@query(
    "e23_snapshot_details",
    "job_events node_events artifacts",
    NODE_CURRENT
    + PAYLOADS
    + LINKS
    + f""" SELECT job_id, 'nodes' AS list, node_id AS item_id, node_type AS name, node_status AS status, CAST(level AS INT) AS level,
      CAST(node_index AS INT) AS item_index, CAST(NULL AS BIGINT) AS counted, CAST(NULL AS INT) AS position FROM node_current
    UNION ALL SELECT job_id, 'node_counts', NULL, node_status, NULL, NULL, NULL, count(*), NULL FROM node_current GROUP BY job_id, node_status
    UNION ALL SELECT job_id, 'artifact_counts', NULL, artifact_type, NULL, NULL, NULL, count(*), NULL FROM artifacts GROUP BY job_id, artifact_type
    UNION ALL SELECT job_id, 'node_links', from_node_id, to_node_id, from_node_type, level, input_index, NULL, NULL FROM links
    UNION ALL SELECT job_id, 'artifacts', CAST(artifact_id AS VARCHAR), artifact_type, stage, level, NULL, NULL, NULL FROM artifacts
    UNION ALL {FIRST_EVENTS.format(list="job_events", status="job_status", limit=200)}
    UNION ALL {FIRST_EVENTS.format(list="node_events", status="node_status", limit=500)}""",
)
def e23_details(t: Tables):
    from logweir.plans.job_snapshot import snapshot_entries

    return snapshot_entries(t.job_events, t.node_events, t.artifacts)
