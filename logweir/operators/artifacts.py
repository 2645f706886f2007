"""Reads over the artifact table and guards on stage results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.operators.jobs import job_current
from logweir.operators.latest import latest
from logweir.operators.nodes import node_current

# Job statuses under which a stage result is thrown away.
DISCARD_STATUSES = ["PAUSE_REQUESTED", "PAUSED", "CANCEL_REQUESTED", "CANCELLED", "FAILED", "DONE"]


def matching(artifacts: DataFrame, **wanted: str | int | None) -> DataFrame:
    """Equality filters on any columns; ``None`` means no filter."""
    for name, value in wanted.items():
        if value is not None:
            artifacts = artifacts.filter(F.col(name) == value)
    return artifacts


def latest_artifacts(
    artifacts: DataFrame,
    keys: Sequence[str] = ("job_id", "node_id", "artifact_type"),
    include_content: bool = True,
    **wanted: str | int | None,
) -> DataFrame:
    """Newest artifact per key under the given filters."""
    rows = matching(artifacts, **wanted)
    if not include_content:
        rows = rows.drop("content")
    return latest(rows, list(keys), ["created_at", "artifact_id"])


def list_artifacts(artifacts: DataFrame, include_content: bool = False, **wanted: str | int | None) -> DataFrame:
    rows = matching(artifacts, **wanted)
    if not include_content:
        rows = rows.drop("content")
    return rows.orderBy("job_id", "level", "stage", "node_id", "created_at", "artifact_id")


def skip_done(nodes: DataFrame, artifacts: DataFrame, artifact_type: str) -> DataFrame:
    """Nodes whose output of the given type does not exist yet."""
    done = artifacts.filter(F.col("artifact_type") == artifact_type).select("job_id", "node_id")
    return nodes.join(done, ["job_id", "node_id"], "left_anti")


def judge_results(
    results: DataFrame, job_events: DataFrame, node_events: DataFrame, expected_status: str = "RUNNING"
) -> DataFrame:
    """Results with a ``discard_reason``; null where the result may be stored."""
    return judge_by_state(results, job_current(job_events), node_current(node_events), expected_status)


def judge_by_state(results: DataFrame, job_state: DataFrame, node_state: DataFrame, expected_status: str = "RUNNING") -> DataFrame:
    """:func:`judge_results` where the current state of jobs and nodes is at hand."""
    jobs = job_state.select("job_id", "job_status")
    nodes = node_state.select("job_id", "node_id", "node_status")
    reason = (
        F.when(F.col("job_status").isNull(), "job_missing")
        .when(F.col("job_status").isin(DISCARD_STATUSES), "job_not_runnable")
        .when(F.col("node_status").isNull(), "node_missing")
        .when(F.col("node_status") != expected_status, "node_status_changed")
    )
    joined = results.join(jobs, "job_id", "left").join(nodes, ["job_id", "node_id"], "left")
    return joined.withColumn("discard_reason", reason)


def accepted_results(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("discard_reason").isNull()).drop("discard_reason")


def discarded_results(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("discard_reason").isNotNull())
