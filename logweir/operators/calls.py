"""Reads over the table of summariser calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.ids import content_hash
from logweir.functions.scalars import non_negative
from logweir.functions.text import estimate_tokens, strip
from logweir.operators.latest import latest

ERROR_TEXT_LIMIT = 2000


def latest_calls(calls: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Newest call per (job, node). Name the columns needed: request and response texts are wide."""
    if columns is not None:
        version = ["created_at", "call_id"]
        calls = calls.select(*dict.fromkeys(["job_id", "node_id", *version, *columns]))
    return latest(calls, ["job_id", "node_id"], ["created_at", "call_id"])


COUNTERS = [
    "latency_ms",
    "pool_wait_ms",
    "provider_latency_ms",
    "prompt_tokens",
    "completion_tokens",
    "total_tokens",
]


def _per_second(tokens: str, millis: str) -> Column:
    speed = F.round(F.col(tokens) / (F.col(millis) / F.lit(1000.0)), 2)
    return F.when(F.col(millis) > 0, F.when(F.col(tokens) > 0, speed).otherwise(F.lit(0.0)))


def llm_telemetry(calls: DataFrame) -> DataFrame:
    """Latency and token speeds of the newest call per node.

    A missing provider latency is the latency without the time spent waiting.
    """
    labels = ["provider", "model", "status", "error_class", "error_message"]
    newest = latest_calls(calls, [*labels, *COUNTERS])
    clean = newest.select(
        "job_id", "node_id", *labels, *[non_negative(F.col(name)).alias(name) for name in COUNTERS]
    ).withColumn("effective_latency_ms", F.col("latency_ms"))
    inferred = F.greatest(F.col("latency_ms") - F.col("pool_wait_ms"), F.lit(0).cast("long"))
    clean = clean.withColumn(
        "provider_latency_ms",
        F.when((F.col("provider_latency_ms") <= 0) & (F.col("latency_ms") > 0), inferred).otherwise(
            F.col("provider_latency_ms")
        ),
    )
    return clean.withColumns(
        {
            "completion_tokens_per_second": _per_second("completion_tokens", "provider_latency_ms"),
            "total_tokens_per_second": _per_second("total_tokens", "provider_latency_ms"),
            "effective_completion_tokens_per_second": _per_second("completion_tokens", "effective_latency_ms"),
            "effective_total_tokens_per_second": _per_second("total_tokens", "effective_latency_ms"),
            "error_message": F.substring("error_message", 1, ERROR_TEXT_LIMIT),
        }
    )


def telemetry_rollup(telemetry: DataFrame) -> DataFrame:
    """Calls, tokens and latencies by model, provider and error class."""
    return telemetry.groupBy("provider", "model", "error_class").agg(
        F.count("*").alias("calls"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("provider_latency_ms").alias("provider_latency_ms"),
        F.max("effective_latency_ms").alias("max_latency_ms"),
    )


MESSAGE = "struct<role:string,content:variant>"


def _flat_text(content: Column) -> Column:
    """Text of a message content: a text, a list of texts and parts, or one part."""

    def own_text(part: Column) -> Column:
        def filled(path: str) -> Column:
            is_text = F.schema_of_variant(F.try_variant_get(part, path, "variant")) == "STRING"
            value = F.try_variant_get(part, path, "string")
            return F.when(is_text & (strip(value) != ""), value)

        return F.coalesce(filled("$.text"), filled("$.content"), F.to_json(part))

    def item(part: Column) -> Column:
        kind = F.schema_of_variant(part)
        return F.when(kind == "STRING", F.try_variant_get(part, "$", "string")).when(
            kind.startswith("OBJECT"), own_text(part)
        )

    kind = F.schema_of_variant(content)
    items = F.transform(F.try_variant_get(content, "$", "array<variant>"), item)
    joined = F.array_join(F.filter(items, lambda text: strip(F.coalesce(text, F.lit(""))) != ""), "\n\n")
    return (
        F.when(content.isNull() | (kind == "VOID"), "")
        .when(kind == "STRING", F.try_variant_get(content, "$", "string"))
        .when(kind.startswith("ARRAY"), joined)
        .when(kind.startswith("OBJECT"), own_text(content))
        .otherwise(F.try_variant_get(content, "$", "string"))
    )


def call_messages(calls: DataFrame) -> DataFrame:
    """Request messages of each call in order, blank ones dropped."""
    messages = F.from_json(F.get_json_object("request_json", "$.messages"), f"array<{MESSAGE}>")
    single = calls.select("call_id", "job_id", "node_id", F.posexplode(messages).alias("position", "_message"))
    role = strip(F.coalesce("_message.role", F.lit("")))
    shaped = single.select(
        "call_id",
        "job_id",
        "node_id",
        "position",
        F.when(role == "", "message").otherwise(role).alias("role"),
        F.col("_message.content").alias("_content"),
    )
    texted = shaped.withColumn("content", strip(_flat_text(F.col("_content")))).drop("_content")
    return texted.filter(F.col("content") != "")


def assistant_messages(calls: DataFrame) -> DataFrame:
    """First non-blank answer of each call."""
    choices = F.from_json(
        F.get_json_object("response_json", "$.choices"), "array<struct<message:struct<content:variant>>>"
    )
    answers = F.transform(choices, lambda choice: strip(_flat_text(choice["message"]["content"])))
    first = F.get(F.filter(answers, lambda text: text != ""), 0)
    plain = strip(F.get_json_object("response_json", "$.content"))
    return calls.select("call_id", "job_id", "node_id", F.coalesce(first, plain, F.lit("")).alias("assistant_message"))


def audit_tokens(calls: DataFrame, system: Column, user: Column, content: Column) -> DataFrame:
    """Token estimates and prompt hashes of each call."""
    sized = calls.select(
        "call_id",
        "job_id",
        "node_id",
        estimate_tokens(system).alias("system_tokens"),
        estimate_tokens(user).alias("user_tokens"),
        F.when(F.length(content) > 0, estimate_tokens(content)).otherwise(F.lit(0).cast("long")).alias("response_tokens"),
        content_hash(system).alias("system_sha256"),
        content_hash(user).alias("user_sha256"),
    )
    total = F.col("system_tokens") + F.col("user_tokens") + F.col("response_tokens")
    return sized.withColumn("total_tokens", total)
