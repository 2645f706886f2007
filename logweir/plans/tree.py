"""The summarisation tree: map, reduce levels, final; all jobs advance together."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions import prompts
from logweir.functions.ids import content_hash, node_id
from logweir.functions.pretty import pretty_json
from logweir.functions.scalars import json_positive_number, json_whole_number
from logweir.functions.schemas import schema_of_examples
from logweir.functions.summaries import reduce_tokens, summary_block, summary_body, summary_json, with_body
from logweir.operators.latest import latest
from logweir.operators.packing import forced_group, index_rows, pack_with_totals
from logweir.plans.summarizers import Summarizer, dry_summarizer
from logweir.session import cut

# Defaults of the reduce grouping.
REDUCE_GROUP_SIZE = 8
REDUCE_TARGET_TOKENS = 4000
MIN_TARGET_TOKENS = 256
NO_INDEX = 10**12

# A broadcast row of job totals is under 100 bytes.
BROADCAST_JOBS = 50_000
SALTS = 32

RESULT_FIELDS = ["ok", "summary", "key_points", "warnings", "source_count"]
_FACTS = ["job_id", "node_id", "node_index", "level", "seq_start", "seq_end"]
_OUTPUT = [*_FACTS, "content", "content_hash", "body", "tokens"]

ORDER = ["seq_start", "seq_end", "node_index", "node_id"]


def create_map_nodes(segments: DataFrame) -> DataFrame:
    """One MAP node with its chunk per segment; a projection, no shuffle."""
    index = F.col("segment_index")
    return segments.select(
        "job_id",
        node_id(F.col("job_id"), "MAP", F.lit(0), index, F.col("content_hash")).alias("node_id"),
        F.lit("MAP").alias("node_type"),
        F.lit(0).alias("level"),
        index.cast("long").alias("node_index"),
        F.col("content_hash").alias("chunk_hash"),
        F.col("content").alias("chunk"),
        "rows_count",
    )


def job_settings(artifacts: DataFrame) -> DataFrame:
    """Settings of each job: the metadata its newest INPUT artifact carries."""
    inputs = artifacts.filter(F.col("artifact_type") == "INPUT")
    newest = latest(inputs, ["job_id"], ["created_at", "artifact_id"], columns=["metadata"])
    return newest.select("job_id", F.get_json_object("metadata", "$.metadata").alias("metadata"))


def with_job_settings(df: DataFrame, settings: DataFrame | None, stage: str) -> DataFrame:
    """Add the job's ``metadata`` JSON and the output ``shape`` it wants in a stage.

    Shapes are worked out on the settings, one row per job, before the join.
    """
    if settings is None:
        empty = F.lit(None).cast("string")
        return df.withColumns({"metadata": empty, "shape": empty})
    shaped = settings.select("job_id", "metadata", prompts.wanted_shape(F.col("metadata"), stage).alias("_wanted"))
    shaped = schema_of_examples(shaped, "_wanted", "_schema").withColumn("shape", pretty_json("_schema"))
    return df.join(shaped.select("job_id", "metadata", "shape"), "job_id", "left")


def _system(stage: str, own: bool) -> Column:
    default = F.lit(prompts.SYSTEM_TEXT[stage])
    if not own:
        return default
    shaped = F.when(F.col("shape").isNotNull(), prompts.SHAPED_SYSTEM_TEXT[stage]).otherwise(default)
    return F.coalesce(prompts.prompt_override(F.col("metadata"), stage, "system"), shaped)


def _template(stage: str, own: bool) -> Column | None:
    return prompts.prompt_override(F.col("metadata"), stage, "user") if own else None


def _shape(own: bool) -> Column | None:
    return F.col("shape") if own else None


def _wanted(own: bool) -> list[str]:
    """The column with the shape of the answer, for jobs that have settings."""
    return ["shape"] if own else []


def _outputs(results: DataFrame, *keep: str) -> DataFrame:
    """Stage results as artifacts: JSON content, its hash, and what the next level needs.

    An object of the job's own shape is the content as it is.
    """
    if "object" in results.columns:
        results = with_body(results, "object", "_own_body")
        given, given_body = F.col("_object"), F.col("_own_body")
        keep_own = [F.col("object").alias("_object"), "_own_body"]
    else:
        given = given_body = F.lit(None).cast("string")
        keep_own = []
    # The value's fields become columns first, so that none is computed twice.
    values = results.select(*_FACTS, *keep, *keep_own, *[F.col(f"result.{name}").alias(f"_{name}") for name in RESULT_FIELDS])
    result = {name: F.col(f"_{name}") for name in RESULT_FIELDS}
    texts = values.select(*_FACTS, *keep, F.coalesce(given, summary_json(result)).alias("content"), F.coalesce(given_body, summary_body(result)).alias("body"))
    return texts.select(
        *_FACTS,
        "content",
        content_hash(F.col("content")).alias("content_hash"),
        "body",
        reduce_tokens(F.col("body")).alias("tokens"),
        *keep,
    )


def _has_answer(results: DataFrame) -> Column:
    has = F.col("result").isNotNull()
    return has | F.col("object").isNotNull() if "object" in results.columns else has


def failed_nodes(results: DataFrame) -> DataFrame:
    """Nodes of a stage without a result: job_id, node_id, stage, reason."""
    reason = F.coalesce("failure", F.lit("no result")) if "failure" in results.columns else F.lit("no result")
    return results.filter(~_has_answer(results)).select("job_id", "node_id", "stage", reason.alias("reason"))


def _answered(results: DataFrame, failed: list[DataFrame] | None) -> DataFrame:
    """Results that are there; nodes without one go to ``failed``."""
    if failed is not None:
        failed.append(failed_nodes(results))
    return results.filter(_has_answer(results))


def without_failed(outputs: DataFrame, failed: list[DataFrame]) -> DataFrame:
    """Outputs of the jobs of which no node has failed so far.

    A summariser that cannot fail has no failed nodes in its plan, and Spark drops the join.
    """
    if not failed:
        return outputs
    jobs = fold(DataFrame.unionByName, failed).select("job_id").distinct()
    return outputs.join(jobs, "job_id", "left_anti")


def map_summarize(
    nodes: DataFrame,
    summarizer: Summarizer = dry_summarizer,
    settings: DataFrame | None = None,
    failed: list[DataFrame] | None = None,
) -> DataFrame:
    """One summariser call per MAP node. Nodes without a result are added to ``failed``."""
    own = settings is not None
    asked = with_job_settings(nodes, settings, "map").select(
        "job_id",
        "node_id",
        "node_index",
        "level",
        F.col("node_index").alias("seq_start"),
        F.col("node_index").alias("seq_end"),
        F.lit("MAP").alias("stage"),
        *_wanted(own),
        _system("map", own).alias("system"),
        prompts.map_user(F.col("chunk"), _template("map", own), _shape(own)).alias("user"),
    )
    return _outputs(_answered(summarizer(asked), failed))


def sequence_bounds(artifacts: DataFrame, node_index: str | None = "node_index") -> DataFrame:
    """Add ``seq_start`` and ``seq_end`` read from artifact metadata.

    Own bounds first, else the segment or chunk index, else the node index.
    """
    number = lambda path: json_whole_number(F.col("metadata"), path)
    start, end = number("$.sequence_start"), number("$.sequence_end")
    single = F.coalesce(number("$.segment_index"), number("$.chunk_index"))
    fallback = F.col(node_index).cast("long") if node_index else F.lit(None).cast("long")
    staged = artifacts.withColumn("_own", start).withColumn("_single", F.coalesce(single, fallback))
    return (
        staged.withColumn("seq_start", F.coalesce("_own", "_single"))
        .withColumn("seq_end", F.when(F.col("_own").isNotNull(), F.coalesce(end, F.col("_own"))).otherwise(F.col("_single")))
        .drop("_own", "_single")
    )


def reduce_order(artifacts: DataFrame, node_index: str | None = "node_index") -> tuple[DataFrame, list[str]]:
    """Artifacts with bounds and the columns that put reduce inputs in order."""
    bounded = sequence_bounds(artifacts, node_index)
    index = F.coalesce(F.col(node_index).cast("long"), F.lit(NO_INDEX)) if node_index else F.lit(NO_INDEX)
    keyed = bounded.withColumns(
        {
            "_unplaced": F.col("seq_start").isNull().cast("int"),
            "_start": F.coalesce(F.col("seq_start"), index),
            "_end": F.coalesce(F.col("seq_end"), index),
            "_index": index,
        }
    )
    return keyed, ["_unplaced", "_start", "_end", "_index", "created_at", "node_id", "artifact_id"]


def order_reduce_inputs(artifacts: DataFrame, node_index: str | None = "node_index") -> DataFrame:
    """Position of each reduce input within its job (``row_index``)."""
    keyed, order = reduce_order(artifacts, node_index)
    return index_rows(keyed, "job_id", order).drop("_unplaced", "_start", "_end", "_index")


def estimate_reduce_tokens(artifacts: DataFrame) -> DataFrame:
    """Add ``tokens``: the stored estimate if positive, else that of the content's block."""
    kept = json_positive_number(F.col("metadata"), "$.reduce_input_estimated_tokens")
    sized = with_body(artifacts, "content", "_body")
    own = F.when(F.length("content") > 0, reduce_tokens(F.col("_body"))).otherwise(F.lit(1).cast("long"))
    return sized.withColumn("tokens", F.coalesce(kept, own)).drop("_body")


def group_reduce_inputs(
    inputs: DataFrame,
    order: list[str],
    max_group: int = REDUCE_GROUP_SIZE,
    budget: int = REDUCE_TARGET_TOKENS,
    jobs: int | None = None,
) -> DataFrame:
    """Assign ``group_index`` by token budget; by fixed size where that makes no progress.

    Adds ``row_index``, ``inputs_count`` and ``grouping_strategy``. ``jobs`` is the
    number of jobs, if known. The totals, one small row per job, are broadcast for few
    jobs; for many they are joined on a salted key, so that a job holding a large share
    of all inputs is spread over many tasks either way.
    """
    size = max(2, max_group)
    packed, totals = pack_with_totals(inputs, "job_id", order, F.col("tokens"), max(MIN_TARGET_TOKENS, budget), size)
    totals = totals.withColumnsRenamed({"rows_count": "inputs_count", "groups_count": "_groups"})
    if jobs is None:
        jobs = inputs.select("job_id").distinct().count()
    if jobs <= BROADCAST_JOBS:
        joined = packed.join(F.broadcast(totals), "job_id")
    else:
        salted = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = packed.withColumn("_salt", (F.col("row_index") % SALTS).cast("int")).join(salted, ["job_id", "_salt"])
    stuck = (F.col("inputs_count") > 1) & (F.col("_groups") >= F.col("inputs_count"))
    fixed = forced_group(F.col("row_index"), F.col("inputs_count"), size)
    return (
        joined.withColumn("group_index", F.when(stuck, fixed).otherwise(F.col("group_index")))
        .withColumn("grouping_strategy", F.when(stuck, "forced_progress").otherwise("token_budget"))
        .drop("_groups", "_salt")
    )


def create_reduce_level(grouped: DataFrame) -> DataFrame:
    """One REDUCE node per group, its members in order. A group is bounded by its size.

    The level comes from the members, not from a literal, so that Spark compiles the
    stages of a level once and uses them for all levels.
    """
    member = F.struct("row_index", "node_id", "content_hash", "body", "tokens", "seq_start", "seq_end")
    groups = grouped.groupBy("job_id", "group_index").agg(
        F.array_sort(F.collect_list(member)).alias("_members"),
        F.first("grouping_strategy").alias("grouping_strategy"),
        (F.max("level") + 1).cast("int").alias("level"),
    )
    members = F.col("_members")
    blocks = F.transform(members, lambda item, i: summary_block(i + F.lit(1), item["body"]))
    hashed = groups.withColumn("input_hash", content_hash(F.array_join(members["content_hash"], "|")))
    return hashed.select(
        "job_id",
        node_id(F.col("job_id"), "REDUCE", F.col("level"), F.col("group_index"), F.col("input_hash")).alias("node_id"),
        F.lit("REDUCE").alias("node_type"),
        "level",
        F.col("group_index").alias("node_index"),
        members["node_id"].alias("input_node_ids"),
        "input_hash",
        F.size(members).alias("input_count"),
        F.aggregate(members["tokens"], F.lit(0).cast("long"), lambda total, item: total + item).alias("input_estimated_tokens"),
        "grouping_strategy",
        F.array_min(members["seq_start"]).alias("seq_start"),
        F.array_max(members["seq_end"]).alias("seq_end"),
        F.array_join(blocks, "\n\n").alias("summaries"),
    )


REDUCE_FACTS = ["input_node_ids", "input_hash", "input_count", "input_estimated_tokens", "grouping_strategy"]


def reduce_summarize(
    nodes: DataFrame,
    summarizer: Summarizer = dry_summarizer,
    settings: DataFrame | None = None,
    failed: list[DataFrame] | None = None,
) -> DataFrame:
    """One summariser call per REDUCE node; the sequence range goes on."""
    own = settings is not None
    asked = with_job_settings(nodes, settings, "reduce").select(
        "job_id",
        "node_id",
        "node_index",
        "level",
        "seq_start",
        "seq_end",
        *REDUCE_FACTS,
        F.concat(F.lit("REDUCE_L"), F.col("level").cast("string")).alias("stage"),
        *_wanted(own),
        _system("reduce", own).alias("system"),
        prompts.reduce_user(F.col("summaries"), _template("reduce", own), _shape(own)).alias("user"),
    )
    return _outputs(_answered(summarizer(asked), failed), *REDUCE_FACTS)


def reduce_level(
    outputs: DataFrame,
    summarizer: Summarizer = dry_summarizer,
    max_group: int = REDUCE_GROUP_SIZE,
    budget: int = REDUCE_TARGET_TOKENS,
    settings: DataFrame | None = None,
    jobs: int | None = None,
    failed: list[DataFrame] | None = None,
) -> DataFrame:
    """Outputs of the next level for jobs that have more than one output."""
    grouped = group_reduce_inputs(outputs, ORDER, max_group, budget, jobs)
    nodes = create_reduce_level(grouped.filter(F.col("inputs_count") > 1))
    return reduce_summarize(nodes, summarizer, settings, failed)


def reduce_tree(
    map_outputs: DataFrame,
    summarizer: Summarizer = dry_summarizer,
    max_group: int = REDUCE_GROUP_SIZE,
    budget: int = REDUCE_TARGET_TOKENS,
    settings: DataFrame | None = None,
    failed: list[DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """The one output each job ends with, and all REDUCE outputs of all levels.

    A job with a failed node leaves the loop without an output: it must not go on
    over the members that are left. ``failed`` holds the nodes that failed before, and
    gets those that fail here.

    Every level is written to the checkpoint folder once and read from there; a job
    that is down to one output leaves the loop. The driver only learns how many jobs
    there are and whether any goes on.
    """
    failed = [] if failed is None else failed
    current, tops, levels = cut(without_failed(map_outputs, failed)), [], []
    while True:
        # One row per job and task survives the partial aggregate, whatever a job's size.
        row = F.first(F.struct(*[name for name in _OUTPUT if name != "job_id"]))
        per_job = current.groupBy("job_id").agg(F.count("*").alias("_outputs"), row.alias("_row"))
        tops.append(per_job.filter(F.col("_outputs") == 1).select("job_id", "_row.*"))
        sizes = current.groupBy("job_id").agg(F.count("*").alias("_outputs"))
        jobs, going_on = sizes.agg(F.count("*"), F.count_if(F.col("_outputs") > 1)).first()
        if not going_on:
            break
        lost: list[DataFrame] = []
        reached = reduce_level(current, summarizer, max_group, budget, settings, jobs, lost)
        current = cut(without_failed(reached, lost))
        failed += lost
        levels.append(current)
    return fold(DataFrame.unionByName, tops), fold(DataFrame.unionByName, levels) if levels else None


def finalize(
    tops: DataFrame,
    summarizer: Summarizer = dry_summarizer,
    settings: DataFrame | None = None,
    failed: list[DataFrame] | None = None,
) -> DataFrame:
    """The FINAL artifact of each job, with report format and own prompts merged in."""
    own = settings is not None
    staged = with_job_settings(tops, settings, "final").withColumn("_format", prompts.report_format(F.col("metadata")))
    asked = staged.select(
        "job_id",
        node_id(F.col("job_id"), "FINAL", F.lit(0), F.lit(0), content_hash(F.col("content"))).alias("node_id"),
        F.lit(0).cast("long").alias("node_index"),
        F.lit(0).alias("level"),
        "seq_start",
        "seq_end",
        F.array("node_id").alias("input_node_ids"),
        F.col("_format.report_format").alias("report_format"),
        F.lit("FINAL").alias("stage"),
        *_wanted(own),
        _system("final", own).alias("system"),
        (
            prompts.final_user(
                F.col("content"), F.col("_format.report_format_instruction"), _template("final", own), _shape(own)
            )
            if own
            else prompts.final_user(F.col("content"))
        ).alias("user"),
    )
    return _outputs(_answered(summarizer(asked), failed), "input_node_ids", "report_format")


def summarize_jobs(
    segments: DataFrame,
    summarizer: Summarizer = dry_summarizer,
    max_group: int = REDUCE_GROUP_SIZE,
    budget: int = REDUCE_TARGET_TOKENS,
    settings: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """One final artifact per finished job, and the failed nodes of all others with stage and reason."""
    failed: list[DataFrame] = []
    mapped = map_summarize(create_map_nodes(segments), summarizer, settings, failed)
    tops, _ = reduce_tree(mapped, summarizer, max_group, budget, settings, failed)
    final = finalize(tops, summarizer, settings, failed)
    return final, fold(DataFrame.unionByName, failed)


def summarize_segments(
    segments: DataFrame,
    summarizer: Summarizer = dry_summarizer,
    max_group: int = REDUCE_GROUP_SIZE,
    budget: int = REDUCE_TARGET_TOKENS,
    settings: DataFrame | None = None,
) -> DataFrame:
    """Segments to one final artifact per job; jobs with a failed node have none."""
    return summarize_jobs(segments, summarizer, max_group, budget, settings)[0]


def load_reduce_inputs(nodes: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored inputs of REDUCE nodes in order, and the inputs that are missing.

    A member's newest MAP summary counts, else its newest REDUCE summary.
    """
    listed = nodes.select(
        "job_id", F.col("node_id").alias("reduce_node_id"), F.posexplode("input_node_ids").alias("input_index", "node_id")
    )
    summaries = artifacts.filter(F.col("artifact_type").isin("MAP_SUMMARY", "REDUCE_SUMMARY"))
    is_map = (F.col("artifact_type") == "MAP_SUMMARY").cast("int")
    best = latest(summaries, ["job_id", "node_id"], [is_map, "created_at", "artifact_id"])
    found = listed.join(best, ["job_id", "node_id"])
    missing = listed.join(best, ["job_id", "node_id"], "left_anti")
    return found, missing
