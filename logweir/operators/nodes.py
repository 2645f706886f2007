"""Read models over the node event log: state, progress, staleness, lineage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.functions.text import strip
from logweir.operators.jobs import micros_between

# Node statuses.
DONE_STATUSES = ["DONE", "SKIPPED_ALREADY_DONE"]
READY_STATUSES = ["PENDING", "WAITING_RETRY"]
TIMED_STATUSES = ["RUNNING", "QUEUED", "WAITING_PROVIDER"]
TYPE_ORDER = ["MAP", "REDUCE", "FINAL"]
OUTPUT_TYPE = {"MAP": "MAP_SUMMARY", "REDUCE": "REDUCE_SUMMARY", "FINAL": "FINAL_SUMMARY"}
SOURCE_NODE = "summary-source"


@dataclass(frozen=True)
class Timeouts:
    """Seconds after which a node that makes no progress is taken up again."""

    queue_seconds: float = 30.0
    call_seconds: float = 600.0
    provider_retry_seconds: float = 5.0

    @property
    def running_seconds(self) -> float:
        return max(self.queue_seconds, self.call_seconds + 120.0)


def node_current(node_events: DataFrame) -> DataFrame:
    """Current row per (job, node): one struct comparison for all columns."""
    state = F.struct(
        "node_type", "level", "node_index", "node_status", F.col("event_type").alias("last_event_type")
    )
    return (
        node_events.groupBy("job_id", "node_id")
        .agg(
            F.max_by(state, F.struct("event_time", "event_id")).alias("_state"),
            F.max("event_time").alias("updated_at"),
            F.count("*").alias("events_count"),
        )
        .select("job_id", "node_id", "_state.*", "updated_at", "events_count")
    )


def list_nodes(node_events: DataFrame, job_id: str) -> DataFrame:
    nodes = node_current(node_events.filter(F.col("job_id") == job_id))
    return nodes.orderBy("level", "node_type", "node_index", "node_id")


def node_payload(node_events: DataFrame) -> DataFrame:
    """Best non-empty payload per node: with inputs, else with a chunk, else any; then newest."""
    payload = F.col("payload")
    rank = (
        F.when(payload.contains('"input_node_ids"'), 3).when(payload.contains('"chunk_hash"'), 2).otherwise(0)
    )
    return (
        node_events.filter(~payload.isin("", "{}"))
        .groupBy("job_id", "node_id")
        .agg(F.max_by("payload", F.struct(rank, F.col("event_time"), F.col("event_id"))).alias("payload"))
    )


def status_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("job_id", "node_status").agg(F.count("*").alias("nodes_count"))


def artifact_counts(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("job_id", "artifact_type").agg(F.count("*").alias("artifacts_count"))


def job_progress(nodes: DataFrame) -> DataFrame:
    """Done and total nodes per job with the percentage rounded half up."""
    done = F.count_if(F.col("node_status") == "DONE")
    grouped = nodes.groupBy("job_id").agg(done.alias("nodes_done"), F.count("*").alias("nodes_total"))
    share = F.floor(F.col("nodes_done") / F.col("nodes_total") * F.lit(100.0) + F.lit(0.5))
    return grouped.withColumn("progress_percent", share.cast("long"))


def stage_progress(
    job_events: DataFrame, nodes: DataFrame, artifacts: DataFrame, segments: DataFrame | None = None
) -> DataFrame:
    """The next step of every job: what an advance over its stored state would do.

    The last reduce level needs a second look at the nodes; it comes from a
    per-job-and-level aggregate, so only small rows meet again.
    """
    from logweir.operators.jobs import runnable_jobs

    is_done = F.col("node_status").isin(DONE_STATUSES)
    levels = nodes.groupBy("job_id", "node_type", "level").agg(
        F.count("*").alias("_nodes"), F.count_if(is_done).alias("_done")
    )
    is_map, is_reduce = F.col("node_type") == "MAP", F.col("node_type") == "REDUCE"
    reduce_level = F.when(is_reduce, F.struct("level", "_nodes", "_done"))
    state = levels.groupBy("job_id").agg(
        F.sum(F.when(is_map, F.col("_nodes")).otherwise(0)).alias("map_nodes"),
        F.sum(F.when(is_map, F.col("_done")).otherwise(0)).alias("map_done"),
        F.max(reduce_level).alias("_last"),
    )
    level = F.col("level")
    outputs = artifacts.filter(F.col("artifact_type").isin("MAP_SUMMARY", "REDUCE_SUMMARY", "FINAL_SUMMARY"))
    per_level = outputs.groupBy("job_id", "artifact_type", level.alias("_out_level")).agg(F.count("*").alias("_outputs"))
    out = per_level.groupBy("job_id").agg(
        F.max(F.when(F.col("artifact_type") == "MAP_SUMMARY", F.col("_outputs"))).alias("_map_outputs"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("artifact_type") == "REDUCE_SUMMARY", F.struct("_out_level", "_outputs")))
        ).alias("_reduce_outputs"),
        F.bool_or(F.col("artifact_type") == "FINAL_SUMMARY").alias("_final"),
    )
    jobs = runnable_jobs(job_events).select("job_id", "job_status")
    joined = jobs.join(state, "job_id", "left").join(out, "job_id", "left")
    has_input = F.lit(True)
    if segments is not None:
        present = segments.select("job_id").distinct().withColumn("_input", F.lit(True))
        joined = joined.join(present, "job_id", "left")
        has_input = F.coalesce("_input", F.lit(False))

    total = F.coalesce("map_nodes", F.lit(0))
    done = F.coalesce("map_done", F.lit(0))
    last = F.coalesce(F.col("_last.level"), F.lit(0))
    last_done = F.col("_last._nodes") == F.col("_last._done")
    left = F.coalesce(F.try_element_at("_reduce_outputs", last), F.lit(0))
    maps_out = F.coalesce("_map_outputs", F.lit(0))
    finished = F.coalesce("_final", F.lit(False))
    after_map = (
        F.when((last == 0) & (maps_out > 1), "reduce")
        .when((last > 0) & ~last_done, "wait_reduce")
        .when((last > 0) & (left > 1), "reduce")
        .when(finished, "done")
        .otherwise("final")
    )
    any_node = total + F.coalesce(F.col("_last._nodes"), F.lit(0)) > 0
    step = (
        F.when(~any_node & ~has_input, "missing_input")
        .when(~any_node, "map")
        .when((total == 0) | (done < total), "wait_map")
        .otherwise(after_map)
    )
    return joined.select(
        "job_id",
        "job_status",
        total.alias("map_nodes"),
        done.alias("map_done"),
        last.cast("int").alias("reduce_level"),
        F.when(last > 0, left).otherwise(maps_out).alias("outputs_left"),
        step.alias("next_step"),
    )


def _expired(as_of: Column, timeouts: Timeouts) -> Column:
    """Whether the time-out of the node's status has passed; no time counts as passed."""
    age = micros_between(F.col("updated_at"), as_of) / F.lit(1_000_000.0)
    limit = (
        F.when(F.col("node_status") == "RUNNING", timeouts.running_seconds)
        .when(F.col("node_status") == "QUEUED", timeouts.queue_seconds)
        .when(F.col("node_status") == "WAITING_PROVIDER", max(1.0, timeouts.provider_retry_seconds))
    )
    return F.when(limit.isNull(), False).otherwise(F.coalesce(age >= limit, F.lit(True)))


def stale_nodes(nodes: DataFrame, as_of: Column, timeouts: Timeouts = Timeouts()) -> DataFrame:
    age = F.floor(micros_between(F.col("updated_at"), as_of) / F.lit(1_000_000)).cast("long")
    return nodes.filter(_expired(as_of, timeouts)).withColumn("age_seconds", age)


def dispatch_backlog(
    nodes: DataFrame,
    as_of: Column,
    timeouts: Timeouts = Timeouts(),
    dispatch_cap: int = 500,
    concurrency: int = 5,
    job_limits: DataFrame | None = None,
) -> DataFrame:
    """Ready nodes that fit the free slots of each (job, node type).

    ``job_limits`` (job_id, job_limit) may lower the limit per job. The row number
    is cut at the overall cap, so Spark prunes each key before the shuffle.
    """
    expired = _expired(as_of, timeouts)
    ready = F.col("node_status").isin(READY_STATUSES) | expired
    active = F.col("node_status").isin(TIMED_STATUSES) & ~expired
    marked = nodes.filter(F.col("node_type").isin("MAP", "REDUCE")).withColumns({"_ready": ready, "_active": active})
    counts = marked.groupBy("job_id", "node_type").agg(
        F.count_if("_ready").alias("ready_nodes"), F.count_if("_active").alias("active_nodes")
    )
    overall = max(1, min(max(1, dispatch_cap), max(1, concurrency)))
    limit = F.lit(overall)
    if job_limits is not None:
        counts = counts.join(job_limits, "job_id", "left")
        limit = F.greatest(F.lit(1), F.least(F.coalesce(F.col("job_limit"), F.lit(overall)), F.lit(overall)))
    slots = counts.select(
        "job_id",
        "node_type",
        "ready_nodes",
        "active_nodes",
        limit.cast("long").alias("dispatch_limit"),
        F.greatest(F.lit(0), limit - F.col("active_nodes")).cast("long").alias("free_slots"),
    )
    order = Window.partitionBy("job_id", "node_type").orderBy("level", "node_index", "node_id")
    first = (
        marked.filter("_ready")
        .select("job_id", "node_type", "node_id", "node_index", "level", F.row_number().over(order).alias("position"))
        .filter(F.col("position") <= overall)
    )
    return first.join(slots, ["job_id", "node_type"]).filter(F.col("position") <= F.col("free_slots"))


def rerun_candidates(nodes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Nodes whose output artifact does not exist."""
    wanted = F.create_map(*[F.lit(item) for pair in OUTPUT_TYPE.items() for item in pair])
    asked = nodes.filter(F.col("node_type").isin(TYPE_ORDER)).withColumn("artifact_type", wanted[F.col("node_type")])
    return asked.join(artifacts, ["job_id", "node_id", "artifact_type"], "left_anti")


def node_links(nodes: DataFrame, payloads: DataFrame) -> DataFrame:
    """Lineage edges: source to MAP, and each listed input to its node."""
    rank = F.create_map(*[item for i, name in enumerate(TYPE_ORDER) for item in (F.lit(name), F.lit(i))])
    # Spelled out, the key filter is the same in all three uses, and their shuffle is shared.
    has_key = F.col("job_id").isNotNull() & F.col("node_id").isNotNull() & (F.col("node_id") != "")
    named = nodes.filter(has_key).select(
        "job_id",
        "node_id",
        "node_type",
        F.coalesce(F.try_element_at(rank, F.col("node_type")), F.lit(9)).alias("type_order"),
        F.greatest(F.col("level").cast("int"), F.lit(0)).alias("level"),
        F.greatest(F.col("node_index").cast("int"), F.lit(0)).alias("node_index"),
    )
    from_source = named.filter(F.col("node_type") == "MAP").select(
        "job_id",
        F.lit(SOURCE_NODE).alias("from_node_id"),
        F.lit("SOURCE").alias("from_node_type"),
        F.col("node_id").alias("to_node_id"),
        F.col("node_type").alias("to_node_type"),
        F.lit(0).alias("input_index"),
        "type_order", "level", "node_index",
    )
    listed = F.from_json(F.get_json_object("payload", "$.input_node_ids"), "array<string>")
    clean = F.filter(F.transform(listed, strip), lambda name: name != "")
    edges = (
        named.filter(F.col("node_type") != "MAP")
        .join(payloads, ["job_id", "node_id"])
        .select("*", F.posexplode(clean).alias("input_index", "from_node_id"))
    )
    types = named.select("job_id", F.col("node_id").alias("from_node_id"), F.col("node_type").alias("_from_type"))
    between = edges.join(types, ["job_id", "from_node_id"], "left").select(
        "job_id",
        "from_node_id",
        F.coalesce("_from_type", F.lit("")).alias("from_node_type"),
        F.col("node_id").alias("to_node_id"),
        F.col("node_type").alias("to_node_type"),
        "input_index",
        "type_order", "level", "node_index",
    )
    return from_source.unionByName(between)


LINK_ORDER = ["job_id", "type_order", "level", "node_index", "to_node_id", "input_index"]
