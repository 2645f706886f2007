"""Queries over the summarisation tree and its steps."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from logweir.catalog import duck
from logweir.catalog.fixtures import Tables
from logweir.catalog.record_queries import SEGMENTS, log_segments
from logweir.catalog.registry import query
from logweir.functions import prompts
from logweir.functions.summaries import summary_block, with_body
from logweir.operators.packing import forced_group, pack_rows
from logweir.plans import tree

# Small groups and budgets, so that the given tables make several reduce levels.
GROUP, REDUCE_BUDGET = 4, 1600
LEVELS = 5

MAP_NODES = SEGMENTS + f""", map_nodes AS (SELECT job_id, segment_index AS node_index, sha256(content) AS chunk_hash, content AS chunk, rows_count,
    {duck.node_id('MAP', '0', 'segment_index', 'sha256(content)')} AS node_id FROM segs)"""
MAP_OUT = MAP_NODES + f""", map_asked AS (SELECT job_id, node_id, node_index, 'MAP' AS stage, {duck.quoted(prompts.USER_TEXT['map'][:-len('{chunk}')])} || chunk AS "user" FROM map_nodes)
, {duck.dry_cte('map_dry', 'map_asked')}
, out0 AS (SELECT job_id, node_id, node_index, 0 AS level, node_index AS seq_start, node_index AS seq_end, content, content_hash, body, tokens FROM map_dry)"""


def grouped_cte(level: int, source: str, group: int, budget: int) -> str:
    """``grp{level}``: rows of ``source`` (job_id, idx, n, tokens, ...) with their reduce group ``g``."""
    forced = (
        f"CASE WHEN {group} > 2 AND n > {group} AND n % {group} = 1 AND q.idx = n - 2 "
        f"THEN q.idx // {group} + 1 ELSE q.idx // {group} END"
    )
    return f"""{duck.packed_cte(f'pk{level}', source, 'job_id', budget, group)}
, tot{level} AS (SELECT job_id, max(grp) + 1 AS groups FROM pk{level} GROUP BY job_id)
, grp{level} AS (SELECT q.*, CASE WHEN t.groups >= n THEN {forced} ELSE p.grp END AS g,
    CASE WHEN t.groups >= n THEN 'forced_progress' ELSE 'token_budget' END AS strategy
  FROM {source} q JOIN pk{level} p ON p.job_id = q.job_id AND p.idx = q.idx JOIN tot{level} t ON t.job_id = q.job_id)"""


def level_cte(level: int, group: int = GROUP, budget: int = REDUCE_BUDGET) -> str:
    """``out{level}`` from ``out{level - 1}``, for the jobs that have several outputs."""
    lf = duck.LF
    block = duck.strip(f"'Summary ' || (pos + 1) || ':' || {lf} || body")
    head = duck.quoted(prompts.USER_TEXT["reduce"][: -len("{summaries}")])
    return f""", ord{level} AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY job_id) AS n,
      row_number() OVER (PARTITION BY job_id ORDER BY seq_start, seq_end, node_index, node_id) - 1 AS idx FROM out{level - 1}) WHERE n > 1)
, {grouped_cte(level, f'ord{level}', group, budget)}
, mem{level} AS (SELECT *, row_number() OVER (PARTITION BY job_id, g ORDER BY idx) - 1 AS pos FROM grp{level})
, red{level} AS (SELECT job_id, g AS node_index, string_agg(content_hash, '|' ORDER BY idx) AS hashes, string_agg(node_id, ',' ORDER BY idx) AS input_node_ids,
    CAST(count(*) AS INT) AS input_count, CAST(sum(tokens) AS BIGINT) AS input_estimated_tokens, any_value(strategy) AS grouping_strategy,
    min(seq_start) AS seq_start, max(seq_end) AS seq_end,
    string_agg({block}, {lf} || {lf} ORDER BY idx) AS summaries FROM mem{level} GROUP BY job_id, g)
, nod{level} AS (SELECT *, sha256(hashes) AS input_hash, {duck.node_id('REDUCE', str(level), 'node_index', 'sha256(hashes)').replace(f"|' || {level} || '|", f"|{level}|")} AS node_id FROM red{level})
, ask{level} AS (SELECT * EXCLUDE (summaries, hashes), 'REDUCE_L{level}' AS stage, {head} || summaries AS "user" FROM nod{level})
, {duck.dry_cte(f'dry{level}', f'ask{level}')}
, out{level} AS (SELECT job_id, node_id, node_index, {level} AS level, seq_start, seq_end, content, content_hash, body, tokens,
    input_node_ids, input_count, input_estimated_tokens, grouping_strategy FROM dry{level})"""


SHOWN = "job_id, node_id, node_index, level, seq_start, seq_end, content, content_hash, tokens"
TREE = MAP_OUT + "".join(level_cte(level) for level in range(1, LEVELS + 1))
TOPS = TREE + ", tops AS (" + " UNION ALL ".join(
    f"SELECT {SHOWN} FROM (SELECT *, count(*) OVER (PARTITION BY job_id) AS outs FROM out{level}) WHERE outs = 1"
    for level in range(LEVELS + 1)
) + ")"
FINAL = TOPS + f""", final_asked AS (SELECT job_id, {duck.node_id('FINAL', '0', '0', 'content_hash').replace("|' || 0 || '|' || 0 || '|", "|0|0|")} AS node_id,
    'FINAL' AS stage, {duck.quoted(prompts.USER_TEXT['final'][:-len('{summaries}')])} || content AS "user", seq_start, seq_end FROM tops)
, {duck.dry_cte('final_dry', 'final_asked')}"""


def map_outputs(t: Tables):
    return tree.map_summarize(tree.create_map_nodes(log_segments(t)))


def shown(outputs):
    return outputs.select(*SHOWN.split(", "))


@query(
    "m1_create_map_nodes",
    "log_records",
    MAP_NODES + " SELECT job_id, node_id, 'MAP' AS node_type, 0 AS level, node_index, chunk_hash, chunk, rows_count FROM map_nodes",
    recursive=True,
)
def m1(t: Tables):
    return tree.create_map_nodes(log_segments(t))


@query("m2_map_summarize", "log_records", MAP_OUT + f" SELECT {SHOWN} FROM out0", recursive=True)
def m2(t: Tables):
    return shown(map_outputs(t))


# Artifacts as stored: bounds in metadata, in several spellings or missing.
BOUNDS = """, bounds AS (SELECT *, TRY_CAST(json_extract_string(metadata, '$.sequence_start') AS BIGINT) AS own,
    TRY_CAST(json_extract_string(metadata, '$.sequence_end') AS BIGINT) AS own_end, TRY_CAST(json_extract_string(metadata, '$.chunk_index') AS BIGINT) AS chunk FROM map_outputs)
, placed AS (SELECT *, coalesce(own, chunk) AS s0, CASE WHEN own IS NOT NULL THEN coalesce(own_end, own) ELSE chunk END AS e0 FROM bounds)
, reduce_in AS (SELECT *, count(*) OVER (PARTITION BY job_id) AS n, row_number() OVER (PARTITION BY job_id ORDER BY
      CASE WHEN s0 IS NULL THEN 1 ELSE 0 END, coalesce(s0, 1000000000000), coalesce(e0, 1000000000000), created_at, node_id, artifact_id) - 1 AS idx, estimate AS tokens FROM placed)"""


def stored_inputs(t: Tables):
    """Stored map outputs with positions; here no node index is known."""
    return tree.order_reduce_inputs(t.map_outputs, node_index=None)


@query(
    "m5_order_reduce_inputs",
    "map_outputs",
    BOUNDS + " SELECT job_id, node_id, s0 AS seq_start, e0 AS seq_end, idx AS row_index FROM reduce_in",
)
def m5(t: Tables):
    return stored_inputs(t).select("job_id", "node_id", "seq_start", "seq_end", "row_index")


@query(
    "m6_group_by_token_budget",
    "map_outputs",
    BOUNDS
    + f""", {duck.packed_cte('packed', 'reduce_in', 'job_id', 1000, 8)}
    SELECT r.job_id, r.node_id, r.idx AS row_index, grp AS group_index FROM reduce_in r JOIN packed p ON p.job_id = r.job_id AND p.idx = r.idx""",
    recursive=True,
)
def m6(t: Tables):
    keyed, order = tree.reduce_order(t.map_outputs, node_index=None)
    packed = pack_rows(keyed, "job_id", order, F.col("estimate"), 1000, 8)
    return packed.select("job_id", "node_id", "row_index", "group_index")


@query(
    "m7_group_forced_progress",
    "map_outputs",
    BOUNDS
    + """ SELECT job_id, node_id, idx AS row_index, n AS inputs_count,
      CASE WHEN n > 8 AND n % 8 = 1 AND idx = n - 2 THEN idx // 8 + 1 ELSE idx // 8 END AS group_index FROM reduce_in""",
)
def m7(t: Tables):
    counts = t.map_outputs.groupBy("job_id").agg(F.count("*").alias("inputs_count"))
    placed = stored_inputs(t).join(counts, "job_id")
    group = forced_group(F.col("row_index"), F.col("inputs_count"), 8)
    return placed.select("job_id", "node_id", "row_index", "inputs_count", group.alias("group_index"))


NODE_FACTS = "job_id, node_id, level, node_index, input_node_ids, input_hash, input_count, input_estimated_tokens, grouping_strategy, seq_start, seq_end, summaries"


@query(
    "m8_create_reduce_level",
    "log_records",
    MAP_OUT + level_cte(1) + f" SELECT {NODE_FACTS.replace('level', '1 AS level', 1)} FROM nod1",
    recursive=True,
)
def m8(t: Tables):
    grouped = tree.group_reduce_inputs(map_outputs(t), tree.ORDER, GROUP, REDUCE_BUDGET)
    nodes = tree.create_reduce_level(grouped.filter("inputs_count > 1"))
    return nodes.withColumn("input_node_ids", F.array_join("input_node_ids", ",")).select(*NODE_FACTS.split(", "))


STORED_BODY = """, bodies AS (SELECT *, CASE WHEN content LIKE '{"ok"%' THEN
      json_extract_string(content, '$.summary') || chr(10) || '- a' || chr(10) || '- ' || json_extract_string(content, '$.key_points[1]')
    ELSE trim(content) END AS body FROM map_outputs)"""


@query(
    "m9_format_reduce_input",
    "map_outputs",
    STORED_BODY + " SELECT node_id, trim('Summary 1:' || chr(10) || body) AS block FROM bodies",
)
def m9(t: Tables):
    blocks = with_body(t.map_outputs)
    return blocks.select("node_id", summary_block(F.lit(1), F.col("body")).alias("block"))


@query(
    "m10_estimate_reduce_tokens",
    "map_outputs",
    STORED_BODY
    + f""" SELECT node_id, CASE WHEN estimate % 3 = 0 THEN estimate ELSE {duck.tokens("trim('Summary 1:' || chr(10) || body)")} END AS tokens FROM bodies""",
)
def m10(t: Tables):
    stored = F.when(F.col("estimate") % 3 == 0, F.to_json(F.struct(F.col("estimate").alias("reduce_input_estimated_tokens")))).otherwise(
        F.when(F.col("estimate") % 3 == 1, '{"reduce_input_estimated_tokens": 0}').otherwise('{"reduce_input_estimated_tokens": "9"}')
    )
    return tree.estimate_reduce_tokens(t.map_outputs.withColumn("metadata", stored)).select("node_id", "tokens")


MEMBERS = """, payloads AS (SELECT job_id, node_id, payload FROM node_events WHERE payload LIKE '%"input_node_ids"%'
    QUALIFY row_number() OVER (PARTITION BY job_id, node_id ORDER BY event_time DESC, event_id DESC) = 1)
, members AS (SELECT job_id, node_id AS reduce_node_id, unnest(['node_' || regexp_extract(payload, 'node_(\\d+)"', 1), 'node_' || regexp_extract(payload, ' node_(\\d+)"', 1)]) AS node_id,
    unnest([0, 1]) AS input_index FROM payloads)
, best AS (SELECT * FROM artifacts WHERE artifact_type IN ('MAP_SUMMARY', 'REDUCE_SUMMARY')
    QUALIFY row_number() OVER (PARTITION BY job_id, node_id ORDER BY CASE WHEN artifact_type = 'MAP_SUMMARY' THEN 0 ELSE 1 END, created_at DESC, artifact_id DESC) = 1)"""


def _listed_nodes(t: Tables):
    from logweir.operators.nodes import node_payload

    ids = F.from_json(F.get_json_object("payload", "$.input_node_ids"), "array<string>")
    clean = F.filter(F.transform(ids, lambda name: F.trim(name)), lambda name: name != "")
    return node_payload(t.node_events).withColumn("input_node_ids", clean).filter(F.size("input_node_ids") > 0)


@query(
    "m11_load_reduce_inputs",
    "node_events artifacts",
    MEMBERS
    + """ SELECT m.job_id, m.reduce_node_id, m.input_index, m.node_id, b.artifact_type, b.artifact_id, b.content
    FROM members m JOIN best b ON b.job_id = m.job_id AND b.node_id = m.node_id""",
)
def m11(t: Tables):
    found, _ = tree.load_reduce_inputs(_listed_nodes(t), t.artifacts)
    return found.select("job_id", "reduce_node_id", "input_index", "node_id", "artifact_type", "artifact_id", "content")


@query(
    "m11_missing_reduce_inputs",
    "node_events artifacts",
    MEMBERS + """ SELECT m.* FROM members m WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.job_id = m.job_id AND b.node_id = m.node_id)""",
)
def m11_missing(t: Tables):
    _, missing = tree.load_reduce_inputs(_listed_nodes(t), t.artifacts)
    return missing.select("job_id", "reduce_node_id", "input_index", "node_id")


@query("m12_reduce_summarize", "log_records", MAP_OUT + level_cte(1) + f" SELECT {SHOWN} FROM out1", recursive=True)
def m12(t: Tables):
    return shown(tree.reduce_level(map_outputs(t), max_group=GROUP, budget=REDUCE_BUDGET))


def _picky(prompts):
    """The deterministic summariser, which has no answer for prompts that speak of purchases."""
    from logweir.plans.summarizers import dry_summarizer

    answered = dry_summarizer(prompts)
    refused = F.col("user").contains("purchase")
    return answered.withColumn("result", F.when(~refused, F.col("result"))).withColumn("failure", F.when(refused, "refused"))


@query(
    "m13_failed_jobs",
    "segments",
    """, judged AS (SELECT job_id, CAST(count_if(content LIKE 'purchase%') AS BIGINT) AS failed_nodes FROM segments GROUP BY job_id)
    SELECT job_id, failed_nodes, failed_nodes = 0 AS finished, CASE WHEN failed_nodes > 0 THEN 'MAP: refused' END AS reason FROM judged""",
)
def m13_failed(t: Tables):
    final, failed = tree.summarize_jobs(t.segments, _picky, max_group=GROUP, budget=REDUCE_BUDGET)
    lost = failed.groupBy("job_id").agg(F.count("*").alias("failed_nodes"), F.max(F.concat_ws(": ", "stage", "reason")).alias("reason"))
    done = final.select("job_id", F.lit(True).alias("finished"))
    return lost.join(done, "job_id", "full").select(
        "job_id", F.coalesce("failed_nodes", F.lit(0).cast("long")).alias("failed_nodes"), F.coalesce("finished", F.lit(False)).alias("finished"), "reason"
    )


@query("m13_reduce_tree", "log_records", TOPS + f" SELECT {SHOWN} FROM tops", recursive=True)
def m13(t: Tables):
    tops, _ = tree.reduce_tree(map_outputs(t), max_group=GROUP, budget=REDUCE_BUDGET)
    return shown(tops)


@query(
    "m13_reduce_levels",
    "log_records",
    TREE
    + " "
    + " UNION ALL ".join(
        f"SELECT job_id, node_id, node_index, {level} AS level, seq_start, seq_end, input_count, input_estimated_tokens, grouping_strategy FROM out{level}"
        for level in range(1, LEVELS + 1)
    ),
    recursive=True,
)
def m13_levels(t: Tables):
    _, levels = tree.reduce_tree(map_outputs(t), max_group=GROUP, budget=REDUCE_BUDGET)
    return levels.select(
        "job_id", "node_id", "node_index", "level", "seq_start", "seq_end", "input_count", "input_estimated_tokens", "grouping_strategy"
    )


@query(
    "m14_finalize",
    "log_records",
    FINAL + " SELECT job_id, node_id, seq_start, seq_end, content, content_hash FROM final_dry",
    recursive=True,
)
def m14(t: Tables):
    tops, _ = tree.reduce_tree(map_outputs(t), max_group=GROUP, budget=REDUCE_BUDGET)
    final = tree.finalize(tops)
    return final.select("job_id", "node_id", "seq_start", "seq_end", "content", "content_hash")


def _total(stage: str, system: str, user: str, shape: str | None = None) -> str:
    """Adds up the rows that a prompt tells of, in the shape that is asked for."""
    rows = sum(int(found) for found in re.findall(r'\brows"?: (\d+)', user))
    if shape is None:
        return json.dumps({"summary": f"rows: {rows}"})
    return json.dumps({"rows": rows, "stage": stage, "of": {"each": []}})


# Settings of a job by its number: none, own shapes in all stages, in the final one, in the stages before it.
SHAPE = {"rows": "integer: all rows", "stage": "string", "of": {"each": ["string"]}}
JOB_SETTINGS = [
    {},
    {"map_reduce_output_json_schema": SHAPE, "output_json_schema": SHAPE},
    {"final_output_json_schema": SHAPE, "report_format": "markdown"},
    {"intermediate_output_json_schema": SHAPE, "report_format": "incident_report"},
]


@query(
    "m14_with_settings",
    "",
    """SELECT 'job_' || user_id AS job_id, CASE user_id % 4 WHEN 2 THEN 'markdown' WHEN 3 THEN 'incident_report' END AS report_format,
      CASE WHEN user_id % 4 IN (1, 2)
        THEN '{' || chr(10) || '  "rows": ' || count(*) || ',' || chr(10) || '  "stage": "FINAL",' || chr(10) || '  "of": {' || chr(10) || '    "each": []' || chr(10) || '  }' || chr(10) || '}'
        ELSE '{' || chr(10) || '  "ok": true,' || chr(10) || '  "summary": "rows: ' || count(*) || '",' || chr(10) || '  "key_points": [],' || chr(10)
          || '  "warnings": [],' || chr(10) || '  "source_count": 1' || chr(10) || '}' END AS content
    FROM events GROUP BY user_id""",
)
def m14_with_settings(t: Tables):
    """The whole tree over jobs with settings of their own, by a callable that answers in the shape each stage asks for."""
    from pyspark.sql import Window

    from logweir.functions.ids import content_hash
    from logweir.plans.summarizers import callable_summarizer

    job = F.concat(F.lit("job_"), "user_id").alias("job_id")
    parts = t.read("events").groupBy("user_id", "event_type").agg(F.count("*").alias("rows_count"))
    # A job has one row per event type here.
    index = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_type")) - 1).alias("segment_index")
    text = F.concat_ws(" ", "event_type", F.lit("rows:"), "rows_count")
    segments = parts.select(job, index, text.alias("content"), content_hash(text).alias("content_hash"), "rows_count")
    chosen = F.get(F.array(*[F.lit(json.dumps({"metadata": settings})) for settings in JOB_SETTINGS]), (F.col("user_id") % len(JOB_SETTINGS)).cast("int"))
    inputs = t.read("events").select("user_id").distinct().select(
        F.concat(F.lit("in_"), "user_id").alias("artifact_id"), job, F.lit("INPUT").alias("artifact_type"), chosen.alias("metadata"), F.lit("2024").alias("created_at")
    )
    summarizer = callable_summarizer(_total, max_calls=8, retries=0)
    return tree.summarize_segments(segments, summarizer, settings=tree.job_settings(inputs)).select("job_id", "report_format", "content")


RESPONSES = [
    "concat('{\"ok\": true, \"summary\": \"', event_type, '\", \"key_points\": [\"a\"], \"warnings\": [], \"source_count\": 3}')",
    "concat('```json\n{\"answer\": \"', event_type, '\", \"warnings\": \"one\"}\n```')",
    "concat('Here it is: {\"root_cause\": \"', event_type, '\", \"sourceCount\": 2} - done')",
    "concat('nothing but ', event_type)",
    "concat('{\"summary\": {\"text\": \"', event_type, '\", \"key_points\": [{\"content\": \"p\"}, \"\", 7]}}')",
    "concat('{\"result\": \"', event_type, '\", \"source_count\": 99999999999, \"warnings\": [\"a\", true]}')",
    "concat('cut {\"summary\": \"', event_type, ' \\\\ud83d')",
]


@query(
    "m4_normalize_responses",
    "",
    """SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 4, 5) THEN event_type WHEN event_id % 7 = 2 THEN 'Root cause: ' || event_type END AS summary,
      CASE event_id % 7 WHEN 0 THEN 'a' WHEN 1 THEN '' WHEN 2 THEN 'root cause: ' || event_type WHEN 4 THEN 'p|7' WHEN 5 THEN '' END AS key_points,
      CASE WHEN event_id % 7 = 1 THEN 'one' WHEN event_id % 7 = 5 THEN 'a|true' WHEN event_id % 7 IN (0, 2, 4) THEN '' END AS warnings,
      CAST(CASE event_id % 7 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 1 WHEN 5 THEN 2147483647 END AS INT) AS source_count, event_id % 7 IN (3, 6) AS failed FROM events""",
)
def m4(t: Tables):
    from logweir.functions.responses import normalize_responses

    given = F.get(F.array(*[F.expr(text) for text in RESPONSES]), (F.col("event_id") % len(RESPONSES)).cast("int"))
    found = normalize_responses(t.spread("events").withColumn("response", given), "response")
    return found.select(
        "event_id", "result.summary", F.array_join("result.key_points", "|").alias("key_points"),
        F.array_join("result.warnings", "|").alias("warnings"), "result.source_count", F.col("parse_error").isNotNull().alias("failed"),
    )


def _fussy(stage: str, system: str, user: str) -> str:
    if user.startswith("error"):
        raise RuntimeError("HTTP 503 from the provider")
    return '{"summary": "fine"}'


@query(
    "m17_retry_calls",
    "",
    """SELECT CAST(event_id AS VARCHAR) AS node_id, CAST(a AS INT) AS attempt, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status,
      CASE WHEN event_type = 'error' THEN 'provider_unavailable' ELSE '' END AS error_class
    FROM events, (VALUES (1), (2), (3)) v(a) WHERE a = 1 OR event_type = 'error'""",
)
def m17(t: Tables):
    from logweir.functions.scalars import classify_error
    from logweir.plans.summarizers import retry_calls

    asked = t.read("events").select(
        F.concat(F.lit("job_"), "user_id").alias("job_id"), F.col("event_id").cast("string").alias("node_id"),
        F.lit("MAP").alias("stage"), F.lit("s").alias("system"), F.concat_ws(" ", "event_type", "props").alias("user"),
    )
    attempts = retry_calls(asked, _fussy, max_calls=8, retries=2, backoff_seconds=0.0)
    kind = F.when(F.col("status") == "ERROR", classify_error(F.col("error_message"))).otherwise("")
    return attempts.select("node_id", "attempt", "status", kind.alias("error_class"))


def _prose(stage: str, system: str, user: str) -> str:
    return "no JSON in these words" if user.startswith(("error", "view")) else '{"summary": "fine"}'


@query(
    "m17_unparseable_retry",
    "",
    """SELECT CAST(event_id AS VARCHAR) AS node_id, CAST(a AS INT) AS attempt, CASE WHEN event_type IN ('error', 'view') THEN 'ERROR' ELSE 'OK' END AS status,
      CASE WHEN event_type IN ('error', 'view') THEN 'schema_or_json' ELSE '' END AS error_class
    FROM events, (VALUES (1), (2)) v(a) WHERE a = 1 OR event_type IN ('error', 'view')""",
)
def m17_unparseable(t: Tables):
    from logweir.functions.scalars import classify_error
    from logweir.plans.summarizers import retry_calls

    asked = t.read("events").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").cast("string").alias("node_id"),
        F.lit("MAP").alias("stage"), F.lit("").alias("system"), F.concat_ws(" ", "event_type", "props").alias("user"),
    )
    tried = retry_calls(asked, _prose, retries=1, backoff_seconds=0.0)
    error = F.when(F.col("status") == "ERROR", classify_error(F.col("error_message"))).otherwise("")
    return tried.select("node_id", "attempt", "status", error.alias("error_class"))


@query(
    "m18_schema_of_examples",
    "",
    """SELECT event_id, CASE WHEN event_id % 2 = 0
      THEN '{"type": "object", "properties": {"k": {"type": "number"}}, "required": ["k"], "additionalProperties": false}'
      ELSE '{"type": "object", "properties": {"kind": {"type": "string", "description": "' || event_type || '"}, "list": {"type": "array", "items": {"type": "integer"}}}, "required": ["kind", "list"], "additionalProperties": false}' END AS json_schema FROM events""",
)
def m18(t: Tables):
    from logweir.functions.schemas import schema_of_examples

    made = F.concat(F.lit('{"kind": "string: '), "event_type", F.lit('", "list": ["integer"]}'))
    given = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(made)
    return schema_of_examples(t.spread("events").withColumn("example", given), "example").select("event_id", "json_schema")


@query(
    "m18_observed_schema",
    "",
    """SELECT event_type, 'OBJECT<k: BIGINT>' AS observed_schema, count(*) AS conforming, CAST(0 AS BIGINT) AS deviating FROM events GROUP BY event_type""",
)
def m18_observed(t: Tables):
    from logweir.functions.schemas import conformance, observed_schema

    events = t.read("events")
    return observed_schema(events, "props", "event_type").join(conformance(events, "props", "k long", "event_type"), "event_type")
