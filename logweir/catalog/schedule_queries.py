"""Queries over versioned snapshots and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.catalog.event_queries import instant
from logweir.catalog.fixtures import Tables
from logweir.catalog.registry import query
from logweir.functions.scalars import run_outcome, sorted_json
from logweir.operators import snapshots
from logweir.operators.cron import next_fire

NOW = "2024-03-01 09:00:00"


def _newest(table: str, key: str) -> str:
    return (
        f", {table}_now AS (SELECT * EXCLUDE (snapshot_id) REPLACE (first_created AS created_at) FROM "
        f"(SELECT *, min(created_at) OVER (PARTITION BY {key}) AS first_created FROM {table} "
        f"QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY updated_at DESC, snapshot_id DESC) = 1))"
    )


PROFILES = _newest("profiles", "profile_id")
SCHEDULES = _newest("schedules", "profile_id")
RUNS = (
    ", runs_now AS (SELECT * EXCLUDE (snapshot_id) FROM runs "
    "QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY updated_at DESC, snapshot_id DESC) = 1)"
)
ACTIVE = """, active AS (SELECT profile_id, count(*) AS active_runs FROM runs_now
  WHERE status IN ('CREATED', 'RUNNING') GROUP BY profile_id)"""
# The five fixture crons spelled out as tests on a local minute; no cron text is read.
FIRES = """CASE cron
    WHEN '*/15 * * * *' THEN minute(l) % 15 = 0
    WHEN '0 9 * * 1-5' THEN minute(l) = 0 AND hour(l) = 9 AND isodow(l) <= 5
    WHEN '30 2 1 * *' THEN minute(l) = 30 AND hour(l) = 2 AND day(l) = 1
    WHEN '0 0 * * 0' THEN minute(l) = 0 AND hour(l) = 0 AND isodow(l) = 7
    ELSE minute(l) = 15 AND hour(l) IN (6, 18) AND (day(l) <= 10 OR isodow(l) = 1) AND month(l) % 2 = 1 END"""
# All quarter hours from the first schedule on, in each zone; fixture crons fire on these only.
CALENDAR = f""", clocks AS (SELECT DISTINCT cron, timezone FROM schedules)
, ticks AS (SELECT cron, timezone, u FROM (
    SELECT cron, timezone, u, timezone(timezone, u AT TIME ZONE 'UTC') AS l
    FROM clocks, (SELECT unnest(generate_series(TIMESTAMP '2024-03-01 00:00:00', TIMESTAMP '2024-05-20 00:00:00', INTERVAL 15 MINUTE)) AS u))
  WHERE {FIRES})"""


@query("p1_latest_profiles", "profiles", PROFILES + " SELECT * EXCLUDE (first_created) FROM profiles_now")
def p1(t: Tables):
    return snapshots.latest_snapshot(t.profiles, "profile_id")


@query("p1_latest_schedules", "schedules", SCHEDULES + " SELECT * EXCLUDE (first_created) FROM schedules_now")
def p1_schedules(t: Tables):
    return snapshots.latest_snapshot(t.schedules, "profile_id")


@query("p1_latest_runs", "runs", RUNS + " SELECT * FROM runs_now")
def p1_runs(t: Tables):
    return snapshots.latest_snapshot(t.runs, "run_id")


@query(
    "p2_list_profiles",
    "profiles",
    PROFILES
    + " SELECT * EXCLUDE (first_created) FROM profiles_now WHERE NOT is_archived ORDER BY updated_at DESC, profile_id LIMIT 500",
)
def p2(t: Tables):
    return snapshots.list_profiles(t.profiles, limit=500)


@query(
    "p3_profiles_with_schedule",
    "profiles schedules",
    PROFILES
    + SCHEDULES
    + """ SELECT p.* EXCLUDE (first_created), cron, timezone, is_enabled, greatest(1, max_active_runs) AS max_active_runs, next_run_at, last_run_at
    FROM profiles_now p LEFT JOIN schedules_now s ON s.profile_id = p.profile_id""",
)
def p3(t: Tables):
    return snapshots.profiles_with_schedule(t.profiles, t.schedules)


@query(
    "p4_due_schedules",
    "schedules",
    SCHEDULES
    + f""" SELECT * EXCLUDE (first_created) FROM schedules_now WHERE is_enabled AND next_run_at <= TIMESTAMP '{NOW}'
    ORDER BY next_run_at, profile_id LIMIT 50""",
)
def p4(t: Tables):
    return snapshots.due_schedules(t.schedules, instant(NOW), limit=50)


@query(
    "p5_list_runs",
    "runs",
    RUNS + " SELECT * FROM runs_now WHERE status = 'RUNNING' ORDER BY updated_at DESC, run_id DESC LIMIT 200",
)
def p5(t: Tables):
    return snapshots.list_runs(t.runs, status="RUNNING", limit=200)


@query("p6_active_runs", "runs", RUNS + ACTIVE + " SELECT * FROM active")
def p6(t: Tables):
    return snapshots.active_runs(t.runs)


@query(
    "p7_tick_report",
    "profiles schedules runs",
    PROFILES
    + SCHEDULES
    + RUNS
    + ACTIVE
    + CALENDAR
    + f""", due AS (SELECT * FROM schedules_now WHERE is_enabled AND next_run_at <= TIMESTAMP '{NOW}')
    , next AS (SELECT cron, timezone, min(u) AS advanced FROM ticks WHERE u > TIMESTAMP '{NOW}' GROUP BY ALL)
    , verdict AS (SELECT d.*, advanced, coalesce(active_runs, 0) AS act, greatest(1, max_active_runs) AS lim,
        CASE WHEN p.profile_id IS NULL THEN 'profile_missing_or_archived'
          WHEN coalesce(active_runs, 0) >= greatest(1, max_active_runs) THEN 'max_active_runs_reached' ELSE '' END AS detail
      FROM due d LEFT JOIN (SELECT profile_id FROM profiles_now WHERE NOT is_archived) p ON p.profile_id = d.profile_id
        LEFT JOIN active a ON a.profile_id = d.profile_id LEFT JOIN next n ON n.cron = d.cron AND n.timezone = d.timezone)
    SELECT profile_id, next_run_at AS due_at, CASE WHEN detail = '' THEN 'launched' ELSE 'skipped' END AS action, detail,
      act AS active_runs, lim AS max_active_runs, advanced AS advanced_next_run_at,
      CASE WHEN detail = '' THEN next_run_at ELSE last_run_at END AS last_run_at FROM verdict""",
)
def p7(t: Tables):
    report = snapshots.tick_report(t.profiles, t.schedules, t.runs, instant(NOW), limit=None)
    return report.withColumn("advanced_next_run_at", F.col("advanced_next_run_at").cast("timestamp_ntz"))


@query(
    "p8_next_fire",
    "schedules",
    SCHEDULES
    + CALENDAR
    + """ SELECT profile_id, s.cron, s.timezone, next_run_at,
      (SELECT min(u) FROM ticks k WHERE k.cron = s.cron AND k.timezone = s.timezone AND u > next_run_at) AS next_fire_at
    FROM schedules_now s WHERE next_run_at IS NOT NULL""",
)
def p8(t: Tables):
    current = snapshots.latest_snapshot(t.schedules, "profile_id").filter("next_run_at IS NOT NULL")
    fired = next_fire(current.select("profile_id", "cron", "timezone", "next_run_at"), "cron", "timezone", "next_run_at")
    return fired.withColumn("next_fire_at", F.col("next_fire_at").cast("timestamp_ntz"))


@query(
    "p9_run_inputs",
    "profiles",
    PROFILES
    + """ SELECT profile_id, '{"mode":"' || CASE WHEN CAST(profile_id AS BIGINT) % 2 = 0 THEN 'partial' ELSE 'full' END
      || '","region":"' || substr(workflow_id, 4) || '"' || CASE WHEN CAST(profile_id AS BIGINT) % 2 = 0 THEN ',"since":"2024"' ELSE '' END || '}' AS inputs
    FROM profiles_now""",
)
def p9(t: Tables):
    current = snapshots.latest_snapshot(t.profiles, "profile_id")
    even = F.col("profile_id").cast("long") % 2 == 0
    override = F.when(even, F.lit('{"mode": "partial", "since": "2024"}')).otherwise("{}")
    return current.select("profile_id", sorted_json(snapshots.run_inputs(F.col("workflow_inputs"), override)).alias("inputs"))


@query(
    "p10_run_outcome",
    "llm_calls",
    """ SELECT call_id, CASE WHEN status = 'ERROR' THEN 'FAILED' ELSE 'DONE' END AS outcome FROM llm_calls""",
)
def p10(t: Tables):
    return t.llm_calls.select("call_id", run_outcome(F.concat(F.lit(" "), F.col("status"))).alias("outcome"))


@query(
    "p11_run_history",
    "runs",
    """ SELECT run_id, profile_id, status, updated_at, snapshot_id, requested_at,
      lag(status) OVER w AS previous_status, lead(updated_at) OVER w AS left_at, lead(status) OVER w AS next_status,
      (epoch_us(updated_at) - epoch_us(requested_at)) // 1000 AS since_request_ms,
      (epoch_us(lead(updated_at) OVER w) - epoch_us(updated_at)) // 1000 AS in_status_ms
    FROM runs WINDOW w AS (PARTITION BY run_id ORDER BY updated_at, snapshot_id)""",
)
def p11(t: Tables):
    return snapshots.run_history(t.runs)
