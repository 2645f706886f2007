"""Versioned snapshots: profiles, schedules, runs and the schedule reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.operators.cron import next_fire
from logweir.operators.jobs import micros_between
from logweir.operators.latest import latest, newest_first
from logweir.operators.ordered import with_next, with_previous

# Run statuses that count as active.
ACTIVE_STATUSES = ["CREATED", "RUNNING"]


def latest_snapshot(df: DataFrame, key: str) -> DataFrame:
    """Newest version per key by (updated_at, snapshot_id).

    ``created_at``, where the table has it, is that of the first version.
    """
    extra: dict[str, Column] = {"updated_at": F.max("updated_at")}
    if "created_at" in df.columns:
        extra["created_at"] = F.min("created_at")
    columns = [name for name in df.columns if name != "snapshot_id"]
    return latest(df, [key], ["updated_at", "snapshot_id"], columns=columns, **extra)


def list_profiles(profiles: DataFrame, include_archived: bool = False, limit: int = 500) -> DataFrame:
    current = latest_snapshot(profiles, "profile_id")
    if not include_archived:
        current = current.filter(~F.col("is_archived"))
    return newest_first(current, limit, F.desc("updated_at"), F.asc("profile_id"))


def profiles_with_schedule(profiles: DataFrame, schedules: DataFrame) -> DataFrame:
    """Every current profile with its current schedule, if any."""
    schedule = latest_snapshot(schedules, "profile_id").select(
        "profile_id",
        "cron",
        "timezone",
        "is_enabled",
        F.greatest(F.lit(1), F.col("max_active_runs").cast("int")).alias("max_active_runs"),
        "next_run_at",
        "last_run_at",
    )
    return latest_snapshot(profiles, "profile_id").join(schedule, "profile_id", "left")


def due_schedules(schedules: DataFrame, now: Column, limit: int | None = 50) -> DataFrame:
    due = latest_snapshot(schedules, "profile_id").filter(
        F.col("is_enabled") & F.col("next_run_at").isNotNull() & (F.col("next_run_at") <= now)
    )
    if limit is None:
        return due
    return newest_first(due, limit, F.asc("next_run_at"), F.asc("profile_id"))


def list_runs(
    runs: DataFrame, profile_id: str | None = None, status: str | None = None, limit: int = 200
) -> DataFrame:
    """Current runs, newest first; filters apply to the current version."""
    current = latest_snapshot(runs, "run_id")
    if profile_id:
        current = current.filter(F.col("profile_id") == profile_id)
    if status:
        current = current.filter(F.col("status") == status)
    return newest_first(current, limit, F.desc("updated_at"), F.desc("run_id"))


def active_runs(runs: DataFrame) -> DataFrame:
    """Active runs per profile, for all profiles at once."""
    newest = latest(runs, ["run_id"], ["updated_at", "snapshot_id"], columns=["profile_id", "status"])
    active = newest.filter(F.col("status").isin(ACTIVE_STATUSES))
    return active.groupBy("profile_id").agg(F.count("*").alias("active_runs"))


def tick_report(
    profiles: DataFrame, schedules: DataFrame, runs: DataFrame, now: Column, limit: int | None = 50
) -> DataFrame:
    """What a scheduler tick at ``now`` would do with each due schedule.

    The next fire time depends on cron, zone and ``now`` only, so it is computed once
    per distinct (cron, zone).
    """
    due = due_schedules(schedules, now, limit).select(
        "profile_id", "cron", "timezone", "max_active_runs", "next_run_at", "last_run_at"
    )
    known = latest_snapshot(profiles, "profile_id").filter(~F.col("is_archived")).select(
        "profile_id", F.lit(True).alias("_known")
    )
    clocks = due.select("cron", "timezone").distinct().withColumn("_now", now)
    clocks = next_fire(clocks, "cron", "timezone", "_now", "advanced_next_run_at").drop("_now")
    allowed = F.greatest(F.lit(1), F.col("max_active_runs").cast("int"))
    running = F.coalesce("active_runs", F.lit(0).cast("long"))
    detail = F.when(F.col("_known").isNull(), "profile_missing_or_archived").when(
        running >= allowed, "max_active_runs_reached"
    )
    return (
        due.join(known, "profile_id", "left")
        .join(active_runs(runs), "profile_id", "left")
        .join(clocks, ["cron", "timezone"], "left")
        .select(
            "profile_id",
            F.col("next_run_at").alias("due_at"),
            F.when(detail.isNull(), "launched").otherwise("skipped").alias("action"),
            F.coalesce(detail, F.lit("")).alias("detail"),
            running.alias("active_runs"),
            allowed.alias("max_active_runs"),
            "advanced_next_run_at",
            F.when(detail.isNull(), F.col("next_run_at")).otherwise(F.col("last_run_at")).alias("last_run_at"),
        )
    )


def run_inputs(profile_inputs: Column, override_inputs: Column) -> Column:
    """Workflow inputs of a run: the profile's, overlaid by the overrides."""
    empty = F.create_map().cast("map<string,string>")
    as_map = lambda text: F.coalesce(F.from_json(text, "map<string,string>"), empty)
    return F.map_concat(as_map(profile_inputs), as_map(override_inputs))


def run_history(runs: DataFrame) -> DataFrame:
    """Every version of a run with its predecessor, its end and the time spent in it."""
    order = ["updated_at", "snapshot_id"]
    slim = runs.select("run_id", "profile_id", "status", *order, "requested_at")
    before = with_previous(slim, "run_id", order, {"previous_status": F.col("status")})
    both = with_next(before, "run_id", order, {"left_at": F.col("updated_at"), "next_status": F.col("status")})
    millis = lambda start, end: (micros_between(F.col(start), F.col(end)) / F.lit(1000)).cast("long")
    return both.withColumns(
        {
            "since_request_ms": millis("requested_at", "updated_at"),
            "in_status_ms": millis("updated_at", "left_at"),
        }
    )
