"""Pipeline tables derived from the given tables, once in Spark and once in SQL.

Every registered query reads one or more of these, so its work grows with the given
tables. Each rule is stated twice, next to each other: ``*_sql`` is the body of the
CTE of the same name that the checking SQL starts with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.session import spread


class Tables:
    """The given tables of one folder, and the tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A given table for costly row-local work."""
        return spread(self.read(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name in DERIVED:
            return DERIVED[name](self)
        raise AttributeError(name)


def _select(table: str, *columns: str) -> Callable[[Tables], DataFrame]:
    return lambda tables: tables.read(table).selectExpr(*columns)


def _spread_select(table: str, *columns: str) -> Callable[[Tables], DataFrame]:
    return lambda tables: tables.spread(table).selectExpr(*columns)


# Names for the event types of the given table, per derived log.
def _case(subject: str, cases: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN '{key}' THEN '{value}'" for key, value in cases.items())
    return f"CASE {subject} {arms} ELSE '{default}' END"


JOB_EVENT = _case(
    "event_type",
    {"signup": "JOB_CREATED", "view": "JOB_RUNNING", "click": "INPUT_READY", "purchase": "JOB_DONE"},
    "JOB_FAILED",
)
JOB_STATUS = _case(
    "event_type",
    {"signup": "CREATED", "view": "RUNNING", "click": "INPUT_READY", "purchase": "DONE"},
    "FAILED",
)
NODE_STATUS = _case(
    "event_type",
    {"signup": "PENDING", "view": "RUNNING", "click": "QUEUED", "purchase": "DONE"},
    "WAITING_PROVIDER",
)
NODE_EVENT = _case(
    "event_type",
    {"signup": "NODE_PENDING", "view": "NODE_STARTED", "click": "NODE_ENQUEUED", "purchase": "NODE_DONE"},
    "NODE_WAITING_PROVIDER",
)
NODE_TYPE = "CASE WHEN event_id % 23 < 14 THEN 'MAP' WHEN event_id % 23 < 21 THEN 'REDUCE' ELSE 'FINAL' END"
NODE_LEVEL = "CASE WHEN event_id % 23 BETWEEN 14 AND 20 THEN 1 + event_id % 23 % 3 ELSE 0 END"
ERROR_TEXT = _case(
    "event_type",
    {
        "signup": "Context length exceeded the maximum",
        "view": "HTTP 429 Too Many Requests",
        "click": "Request timed out after 600 s",
        "purchase": "",
    },
    "JSON validation failed",
)
KEY_JSON = "get_json_object(props, '$.k')"

# Portable SQL expressions: the same text runs in both engines.
PAD_ID = "lpad(CAST(event_id AS STRING), 12, '0')"
JOB_ID = "concat('job_', CAST(user_id AS STRING))"
NODE_ID = "concat('node_', CAST(event_id % 23 AS STRING))"

NODE_PAYLOAD = (
    "CASE WHEN event_type = 'error' THEN '{}' "
    "WHEN event_id % 23 < 14 THEN concat('{\"chunk_hash\": \"', CAST(event_id AS STRING), '\"}') "
    "WHEN event_type = 'view' THEN '{\"note\": \"started\"}' "
    "ELSE concat('{\"input_node_ids\": [\"node_', CAST(event_id % 14 AS STRING), "
    "'\", \" node_', CAST(event_id % 31 AS STRING), '\", \"\"]}') END"
)

# ----------------------------------------------------------------- log rows
# Loose export columns, as the normaliser gets them.
RAW_ROWS = [
    "concat('job_', CAST(user_id AS STRING)) AS job_id",
    "event_id AS pos",
    "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS Time",
    "CASE WHEN event_id % 4 = 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:59') ELSE '' END AS finish_time",
    "concat(' ', event_type, ' ') AS Namespace",
    "concat('svc-', CAST(user_id % 5 AS STRING)) AS container",
    "CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('pod-', CAST(user_id % 7 AS STRING)) END AS pod",
    f"{KEY_JSON} AS k",
    "CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 10 AS STRING) END AS shard",
    "CASE WHEN event_id % 11 = 0 THEN '  ' ELSE concat(event_type, ' value=', "
    "CAST(CAST(floor(value) AS BIGINT) AS STRING), ' ', props) END AS Message",
]
RAW_ROWS_SQL = """raw_rows AS (
  SELECT 'job_' || user_id AS job_id, event_id AS pos,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS "Time",
    CASE WHEN event_id % 4 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:59') ELSE '' END AS finish_time,
    ' ' || event_type || ' ' AS "Namespace",
    'svc-' || (user_id % 5) AS container,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE 'pod-' || (user_id % 7) END AS pod,
    json_extract_string(props, '$.k') AS k,
    CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 10 AS VARCHAR) END AS shard,
    CASE WHEN event_id % 11 = 0 THEN '  ' ELSE event_type || ' value=' || CAST(floor(value) AS BIGINT) || ' ' || props END AS "Message"
  FROM events)"""

# Normalised by hand in SQL: what the record of each raw row must be.
LOG_RECORDS_SQL = RAW_ROWS_SQL + """, cells AS (
  SELECT job_id, pos, "Time" AS timestamp, finish_time AS end_time, trim("Namespace") AS namespace,
    container AS container_name, pod AS pod_name, k, coalesce(shard, '') AS shard, trim("Message") AS message
  FROM raw_rows), log_records AS (
  SELECT job_id, pos, timestamp, end_time, namespace, container_name, pod_name, k, shard,
    CASE WHEN message <> '' THEN message
      ELSE list_aggregate(list_filter([timestamp, end_time, namespace, container_name, pod_name, k, shard, message], lambda c: c <> ''), 'string_agg', ' ') END AS raw_line
  FROM cells), rendered AS (
  SELECT *, list_aggregate(list_filter([
      '[' || timestamp || ' -> ' || CASE WHEN end_time <> '' THEN end_time ELSE timestamp END || ']',
      'namespace=' || namespace, 'container=' || container_name,
      CASE WHEN pod_name <> '' THEN 'pod=' || pod_name ELSE '' END,
      'k=' || k, CASE WHEN shard <> '' THEN 'shard=' || shard ELSE '' END, raw_line], lambda c: c <> ''), 'string_agg', '  ') AS line
  FROM log_records), lines AS (
  SELECT *, greatest(1, CAST(ceil(length(line) / CAST(2.2 AS DOUBLE)) AS BIGINT)) AS tokens FROM rendered)"""

# --------------------------------------------------------------- event logs
JOB_EVENTS = [
    f"{PAD_ID} AS event_id",
    f"{JOB_ID} AS job_id",
    "ts AS event_time",
    f"{JOB_EVENT} AS event_type",
    f"{JOB_STATUS} AS job_status",
    "'worker' AS actor",
    "props AS message",
    "props AS payload",
]
NODE_EVENTS = [
    f"{PAD_ID} AS event_id",
    f"{JOB_ID} AS job_id",
    f"{NODE_ID} AS node_id",
    "ts AS event_time",
    f"{NODE_EVENT} AS event_type",
    f"{NODE_STATUS} AS node_status",
    f"{NODE_TYPE} AS node_type",
    f"CAST({NODE_LEVEL} AS INT) AS level",
    "CAST(event_id % 23 AS INT) AS node_index",
    "0 AS attempt",
    "'worker' AS actor",
    "props AS message",
    f"{NODE_PAYLOAD} AS payload",
]
# Uploads: every signup stages a file; some entries are reused or unreadable.
STAGED_PAYLOAD = (
    "CASE WHEN event_id % 7 = 0 THEN '{broken' "
    "WHEN event_id % 5 = 0 THEN '{\"reused_upload\": true, \"source\": {\"filename\": \"again.csv\"}}' "
    "ELSE concat('{\"source\": {\"filename\": \"f', CAST(event_id AS STRING), '.csv\", \"format\": \"csv\", "
    "\"content_type\": \"text/csv\"}, \"staging\": {\"path\": \"/staging/', CAST(event_id AS STRING), "
    "'\", \"size_bytes\": ', CAST(user_id * 1000 AS STRING), '}}') END"
)
UPLOAD_EVENTS = [
    f"{PAD_ID} AS event_id",
    f"{JOB_ID} AS job_id",
    "ts AS event_time",
    f"CASE WHEN event_type = 'signup' THEN 'FILE_STAGED' ELSE {JOB_EVENT} END AS event_type",
    f"{JOB_STATUS} AS job_status",
    "'api' AS actor",
    "'' AS message",
    f"CASE WHEN event_type = 'signup' THEN {STAGED_PAYLOAD} ELSE '{{}}' END AS payload",
]
ARTIFACTS = [
    f"{PAD_ID} AS artifact_id",
    f"{JOB_ID} AS job_id",
    f"{NODE_ID} AS node_id",
    f"CASE WHEN event_id % 23 < 14 THEN 'MAP_SUMMARY' WHEN event_id % 23 < 21 THEN 'REDUCE_SUMMARY' ELSE 'FINAL_SUMMARY' END AS artifact_type",
    f"{NODE_TYPE} AS stage",
    f"CAST({NODE_LEVEL} AS INT) AS level",
    "sha2(props, 256) AS content_hash",
    "props AS content",
    "concat('{\"sequence_start\": ', CAST(event_id % 23 AS STRING), '}') AS metadata",
    "ts AS created_at",
]
SEGMENTS = [
    f"{JOB_ID} AS job_id",
    "CAST(event_id % 7 AS INT) AS segment_index",
    "CASE WHEN event_id % 2 = 0 THEN 'upload' ELSE '' END AS source_type",
    "'csv' AS source_format",
    "sha2(concat(event_type, props), 256) AS content_hash",
    "concat(event_type, props) AS content",
    "CAST(floor(value) AS INT) AS rows_count",
    "CAST(length(concat(event_type, props)) AS INT) AS chars",
    "'{\"first_timestamp\":\"a\",\"last_timestamp\":\"b\"}' AS metadata",
    "ts AS created_at",
]
LLM_CALLS = [
    f"{PAD_ID} AS call_id",
    f"{JOB_ID} AS job_id",
    f"{NODE_ID} AS node_id",
    "ts AS created_at",
    "'dry-run' AS provider",
    "concat('model-', CAST(user_id % 3 AS STRING)) AS model",
    "CASE WHEN event_type = 'purchase' THEN 'OK' ELSE 'ERROR' END AS status",
    f"{ERROR_TEXT} AS error_message",
    "CAST(floor(value * 10) AS BIGINT) AS latency_ms",
    "CAST(floor(value) AS BIGINT) AS pool_wait_ms",
    "CASE WHEN event_id % 2 = 0 THEN 0 ELSE CAST(floor(value * 9) AS BIGINT) END AS provider_latency_ms",
    f"CAST({KEY_JSON} AS BIGINT) AS prompt_tokens",
    f"CAST({KEY_JSON} AS BIGINT) * 2 AS completion_tokens",
    f"CAST({KEY_JSON} AS BIGINT) * 3 AS total_tokens",
]
# Reduce inputs: one map summary per event; every fifth has no sequence bounds.
MAP_OUTPUTS = [
    f"{JOB_ID} AS job_id",
    "concat('map_', CAST(event_id AS STRING)) AS node_id",
    "CAST(1000 - event_id % 1000 AS INT) AS node_index",
    f"{PAD_ID} AS artifact_id",
    "CASE WHEN event_id % 5 = 0 THEN '{}' WHEN event_id % 7 = 0 THEN concat('{\"chunk_index\": ', CAST(event_id % 50 AS STRING), '}') "
    "ELSE concat('{\"sequence_start\": ', CAST(event_id % 40 AS STRING), ', \"sequence_end\": \"', CAST(event_id % 40 + event_id % 3 AS STRING), '\"}') END AS metadata",
    "sha2(concat(props, CAST(event_id AS STRING)), 256) AS content_hash",
    "CASE WHEN event_id % 9 = 0 THEN concat('{\"ok\":true,\"summary\":\"', event_type, '\",\"key_points\":[\"a\",\"b ', event_type, '\"],\"warnings\":[],\"source_count\":1}') ELSE concat('  ', event_type, ' ', props) END AS content",
    "CAST(40 + event_id * 13 % 500 AS BIGINT) AS estimate",
    "ts AS created_at",
]

# ------------------------------------------------------- versioned snapshots
CRONS = ["*/15 * * * *", "0 9 * * 1-5", "30 2 1 * *", "0 0 * * 0", "15 6,18 1-10 */2 mon"]
ZONES = ["UTC", "Europe/Berlin", "America/New_York"]


def _pick(column: str, items: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{item}'" for i, item in enumerate(items))
    return f"CASE {column} % {len(items)} {arms} END"


PROFILES = [
    "concat('s', CAST(c_custkey AS STRING), '-', CAST(version AS STRING)) AS snapshot_id",
    "CAST(c_custkey AS STRING) AS profile_id",
    "CASE WHEN version = 1 THEN c_name ELSE concat(c_name, ' v2') END AS name",
    "c_mktsegment AS service",
    "'' AS description",
    "concat('wf-', CAST(c_nationkey AS STRING)) AS workflow_id",
    "concat('{\"region\": \"', CAST(c_nationkey AS STRING), '\", \"mode\": \"full\"}') AS workflow_inputs",
    "'{}' AS metadata",
    "version = 2 AND c_acctbal < 0 AS is_archived",
    "TIMESTAMP '2024-01-01 00:00:00' AS created_at",
    "CASE WHEN version = 1 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-01-02 00:00:00' END AS updated_at",
]
SCHEDULES = [
    "concat('s', CAST(c_custkey AS STRING), '-', CAST(version AS STRING)) AS snapshot_id",
    "CAST(c_custkey AS STRING) AS profile_id",
    f"{_pick('c_custkey', CRONS)} AS cron",
    f"{_pick('c_custkey', ZONES)} AS timezone",
    "c_custkey % 13 <> 0 AS is_enabled",
    "CAST(c_custkey % 3 AS INT) AS max_active_runs",
    "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE TIMESTAMP '2024-03-01 00:00:00' + version * INTERVAL '1' HOUR + c_custkey * INTERVAL '1' MINUTE END AS next_run_at",
    "CASE WHEN version = 2 THEN TIMESTAMP '2024-02-29 12:00:00' END AS last_run_at",
    "TIMESTAMP '2024-01-01 00:00:00' + version * INTERVAL '1' DAY AS created_at",
    "TIMESTAMP '2024-01-01 00:00:00' + version * INTERVAL '1' DAY AS updated_at",
]
RUNS = [
    "concat('s', CAST(o_orderkey AS STRING), '-', CAST(version AS STRING)) AS snapshot_id",
    "concat('run_', CAST(o_orderkey AS STRING)) AS run_id",
    "CAST(o_custkey AS STRING) AS profile_id",
    "CASE WHEN version = 2 THEN 'DONE' WHEN o_orderstatus = 'F' THEN 'DONE' WHEN o_orderstatus = 'O' THEN 'RUNNING' ELSE 'CREATED' END AS status",
    "'MANUAL' AS trigger_type",
    "'wf' AS workflow_id",
    "o_orderdate AS requested_at",
    "o_orderpriority AS error_message",
    "CASE WHEN version = 1 THEN o_orderdate ELSE o_orderdate + INTERVAL '1' DAY END AS updated_at",
]
TURN_CALLS = [
    "concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS call_id",
    "concat('job_', CAST(conv_id AS STRING)) AS job_id",
    "concat('node_', CAST(turn AS STRING)) AS node_id",
    "CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS role",
    "text",
]


def _to_duck(columns: list[str]) -> str:
    text = ", ".join(columns)
    return (
        text.replace("AS STRING", "AS VARCHAR")
        .replace("get_json_object", "json_extract_string")
        .replace("sha2(", "sha256(")
        .replace(", 256)", ")")
    )


def _to_spark(columns: list[str]) -> list[str]:
    return [column.replace("TIMESTAMP '", "TIMESTAMP_NTZ '") for column in columns]


VERSIONS = "explode(array(1, 2)) AS version"


def _versioned(table: str, columns: list[str], keep: str = "true") -> Callable[[Tables], DataFrame]:
    def build(tables: Tables) -> DataFrame:
        doubled = tables.read(table).selectExpr("*", VERSIONS).filter(keep)
        return doubled.selectExpr(*_to_spark(columns))

    return build


RUN_VERSIONS = "version = 1 OR o_orderkey % 3 = 0"


def _turn_calls(tables: Tables) -> DataFrame:
    turns = tables.spread("conversations").selectExpr(*TURN_CALLS)
    message = F.struct("role", F.col("text").alias("content"))
    blank = F.struct(F.lit("user").alias("role"), F.lit("  ").alias("content"))
    choice = F.struct(F.struct(F.col("text").alias("content")).alias("message"))
    return turns.select(
        "call_id",
        "job_id",
        "node_id",
        F.to_json(F.struct(F.array(blank, message).alias("messages"))).alias("request_json"),
        F.to_json(F.struct(F.array(choice).alias("choices"))).alias("response_json"),
    )


DERIVED: dict[str, Callable[[Tables], DataFrame]] = {
    "raw_rows": _spread_select("events", *RAW_ROWS),
    "job_events": _select("events", *JOB_EVENTS),
    "node_events": _select("events", *NODE_EVENTS),
    "upload_events": _select("events", *UPLOAD_EVENTS),
    "artifacts": _select("events", *_to_spark(ARTIFACTS)),
    "segments": _select("events", *_to_spark(SEGMENTS)),
    "llm_calls": _select("events", *LLM_CALLS),
    "map_outputs": _spread_select("events", *_to_spark(MAP_OUTPUTS)),
    "profiles": _versioned("customer", PROFILES),
    "schedules": _versioned("customer", SCHEDULES),
    "runs": _versioned("orders", RUNS, RUN_VERSIONS),
    "turn_calls": _turn_calls,
}

_EVENT_SQL = {
    "job_events": JOB_EVENTS,
    "node_events": NODE_EVENTS,
    "upload_events": UPLOAD_EVENTS,
    "artifacts": ARTIFACTS,
    "segments": SEGMENTS,
    "llm_calls": LLM_CALLS,
    "map_outputs": MAP_OUTPUTS,
}

FIXTURE_SQL: dict[str, str] = {
    **{name: f"{name} AS (SELECT {_to_duck(columns)} FROM events)" for name, columns in _EVENT_SQL.items()},
    "profiles": f"profiles AS (SELECT {_to_duck(PROFILES)} FROM customer, (VALUES (1), (2)) v(version))",
    "schedules": f"schedules AS (SELECT {_to_duck(SCHEDULES)} FROM customer, (VALUES (1), (2)) v(version))",
    "runs": f"runs AS (SELECT {_to_duck(RUNS)} FROM orders, (VALUES (1), (2)) v(version) WHERE {RUN_VERSIONS})",
    "turn_calls": f"turn_calls AS (SELECT {_to_duck(TURN_CALLS)} FROM conversations)",
    "log_records": LOG_RECORDS_SQL,
    "raw_rows": RAW_ROWS_SQL,
}


def with_tables(*names: str, recursive: bool = False) -> str:
    """The WITH clause that defines the named derived tables."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(FIXTURE_SQL[name] for name in names)
