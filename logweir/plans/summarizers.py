"""Summarisers: functions from prompts to results, both DataFrames.

Prompts have ``job_id, node_id, stage, system, user`` and, where jobs have settings, ``shape``:
the JSON Schema of the answer a job wants, null for the summary value. A summariser keeps all
columns and adds ``result`` (see ``SUMMARY_TYPE``), null for a prompt without a usable answer; it
may add ``object``, the JSON object that answers a prompt with a shape in place of a result,
and ``failure``, the reason. The default is pure Spark SQL. Any Python callable can take its
place; it is called in Arrow batches, at most ``max_calls`` at a time, and every attempt is
recorded. An answer without JSON is an attempt that failed, and is tried again.
"""

from __future__ import annotations

import inspect
import json
import time
from collections.abc import Callable, Iterator
from math import ceil
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions.ids import content_hash
from logweir.functions.responses import normalize_responses, object_responses
from logweir.functions.scalars import classify_error
from logweir.functions.summaries import dry_result
from logweir.functions.text import estimate_tokens
from logweir.session import cut, ensure_checkpoint_dir

Summarizer = Callable[[DataFrame], DataFrame]

# Retry defaults.
MAX_RETRIES = 3
BACKOFF_SECONDS = 2.0
MAX_CALLS = 5
#: Prompts of one task of the first wave, about.
TASK_PROMPTS = 500
#: What a lost task asks again: waves that take under half of it are followed by larger ones.
WAVE_SECONDS = 60.0
#: Places of prompts in the order of their hash; a wave is a range of them.
PLACES = 2**40

ATTEMPT_FIELDS = (
    "job_id string, node_id string, stage string, attempt int, status string, "
    "response string, error_message string, latency_ms long, shaped boolean"
)


def dry_summarizer(prompts: DataFrame) -> DataFrame:
    """The deterministic default."""
    return prompts.withColumn("result", dry_result(F.col("stage"), F.col("user")))


class NoJson(ValueError):
    """An answer in which no JSON value can be read."""


def require_json(response: str, an_object: bool = False) -> str:
    """The answer, if a JSON value (or object) starts somewhere in it and can be read to its end."""
    decoder, starts = json.JSONDecoder(), [response.find(mark) for mark in "{["]
    text = response.strip()
    try:
        value, _ = decoder.raw_decode(text)
    except (ValueError, RecursionError):
        first = min((start for start in starts if start >= 0), default=None)
        if first is None:
            raise NoJson("the answer holds no JSON") from None
        try:
            value, _ = decoder.raw_decode(response, first)
        except (ValueError, RecursionError) as error:
            raise NoJson(f"the JSON of the answer cannot be read: {error}") from None
    if an_object and not isinstance(value, dict):
        raise NoJson("the JSON of the answer is no object")
    return response


def _takes_shape(call: Callable[..., str]) -> bool:
    try:
        parameters = inspect.signature(call).parameters
    except (TypeError, ValueError):
        return False
    return "shape" in parameters


def _attempts(call: Callable[..., str], retries: int, backoff_seconds: float):
    takes_shape = _takes_shape(call)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for prompt in batch.itertuples(index=False):
                shape = prompt.shape if isinstance(prompt.shape, str) else None
                options = {"shape": shape} if takes_shape else {}
                for attempt in range(1, retries + 2):
                    started = time.monotonic()
                    status, response, error = "OK", "", ""
                    try:
                        response = call(prompt.stage, prompt.system, prompt.user, **options)
                        require_json(response, shape is not None)
                    except Exception as failure:  # every failure of the callable is an attempt of its own
                        status, error = "ERROR", str(failure)
                    millis = int((time.monotonic() - started) * 1000)
                    rows.append((prompt.job_id, prompt.node_id, prompt.stage, attempt, status, response, error, millis, shape is not None))
                    if status == "OK":
                        break
                    if attempt <= retries:
                        time.sleep(backoff_seconds * attempt)
            names = [field.split()[0] for field in ATTEMPT_FIELDS.split(", ")]
            yield pd.DataFrame(rows, columns=names)

    return run


def retry_calls(
    prompts: DataFrame,
    call: Callable[..., str],
    max_calls: int = MAX_CALLS,
    retries: int = MAX_RETRIES,
    backoff_seconds: float = BACKOFF_SECONDS,
    task_prompts: int = TASK_PROMPTS,
) -> DataFrame:
    """All attempts, one row each, up to ``retries`` further ones after an error.

    An answer without JSON, or to a prompt with a shape anything but an object, is an error.
    Prompts are asked in waves of ``max_calls`` tasks, so the calls in flight are capped however many
    prompts there are. A task of the first wave has about ``task_prompts`` prompts. Every wave is a Spark job
    with a cost of its own, so while calls are fast each wave asks twice as many as the one before; a lost task
    asks again what it had asked in about ``WAVE_SECONDS``, or its ``task_prompts`` if these take longer.
    Attempts of a wave are written before the next one starts; reading them does not call again.
    """
    shape = F.col("shape") if "shape" in prompts.columns else F.lit(None).cast("string").alias("shape")
    slim = cut(prompts.select("job_id", "node_id", "stage", "system", "user", shape))
    attempts = _attempts(call, retries, backoff_seconds)
    first = max_calls * task_prompts
    total = slim.count()
    if total <= first:
        return cut(slim.repartition(max_calls).mapInPandas(attempts, ATTEMPT_FIELDS))
    spark = prompts.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/calls-{uuid4().hex}"
    # In the order of a hash, so that a wave reads no more than its own part of the files.
    place = F.pmod(F.xxhash64("job_id", "node_id", "stage"), F.lit(PLACES)).alias("_place")
    placed = slim.select("*", place)
    placed.repartitionByRange("_place").sortWithinPartitions("_place").write.parquet(f"{folder}/prompts")
    asked = spark.read.schema(placed.schema).parquet(f"{folder}/prompts")
    start, least = 0, ceil(PLACES * first / total)
    width = least
    while start < PLACES:
        part = asked.filter((F.col("_place") >= start) & (F.col("_place") < start + width)).drop("_place").repartition(max_calls)
        began = time.monotonic()
        part.mapInPandas(attempts, ATTEMPT_FIELDS).write.mode("append").parquet(f"{folder}/attempts")
        start, width = start + width, next_width(width, least, time.monotonic() - began)
    return spark.read.schema(ATTEMPT_FIELDS).parquet(f"{folder}/attempts")


def next_width(width: int, least: int, seconds: float) -> int:
    """Places of the next wave, by the time the last one took."""
    if seconds < WAVE_SECONDS / 2:
        return width * 2
    return max(least, width // 2) if seconds > WAVE_SECONDS else width


def call_rows(attempts: DataFrame, prompts: DataFrame, provider: str, model: str) -> DataFrame:
    """Rows for the table of calls."""
    asked = prompts.select("job_id", "node_id", "stage", "system", "user")
    joined = attempts.join(asked, ["job_id", "node_id", "stage"])
    message = lambda role: F.struct(F.lit(role).alias("role"), F.col(role).alias("content"))
    request = F.to_json(F.struct(F.lit(model).alias("model"), F.array(message("system"), message("user")).alias("messages")))
    asked_tokens = estimate_tokens(F.col("system")) + estimate_tokens(F.col("user"))
    answered = F.when(F.length("response") > 0, estimate_tokens(F.col("response"))).otherwise(F.lit(0).cast("long"))
    is_error = F.col("status") == "ERROR"
    identity = F.concat_ws("|", "job_id", "node_id", "stage", F.col("attempt").cast("string"))
    return joined.select(
        content_hash(identity).alias("call_id"),
        "job_id",
        "node_id",
        "attempt",
        F.lit(provider).alias("provider"),
        F.lit(model).alias("model"),
        "status",
        F.when(is_error, classify_error(F.col("error_message"))).otherwise("").alias("error_class"),
        "latency_ms",
        asked_tokens.alias("prompt_tokens"),
        answered.alias("completion_tokens"),
        (asked_tokens + answered).alias("total_tokens"),
        request.alias("request_json"),
        F.to_json(F.struct(F.col("response").alias("content"))).alias("response_json"),
        "error_message",
    )


def callable_summarizer(
    call: Callable[..., str],
    max_calls: int = MAX_CALLS,
    retries: int = MAX_RETRIES,
    backoff_seconds: float = BACKOFF_SECONDS,
    on_attempts: Callable[[DataFrame, DataFrame], None] | None = None,
) -> Summarizer:
    """A summariser around ``call(stage, system, user) -> response text``.

    A callable with a parameter ``shape`` gets the JSON Schema of the wanted answer, or None.
    The object that answers a prompt with a shape is kept as it is.

    Prompts whose attempts all failed stay in the results, without a result and with the
    last error as ``failure``. ``on_attempts`` gets (attempts, prompts), e.g. to append calls.
    """

    def summarize(prompts: DataFrame) -> DataFrame:
        attempts = retry_calls(prompts, call, max_calls, retries, backoff_seconds)
        if on_attempts is not None:
            on_attempts(attempts, prompts)
        keys = ["job_id", "node_id", "stage"]
        good = attempts.filter(F.col("status") == "OK").select(
            *keys, F.when(~F.col("shaped"), F.col("response")).alias("_plain"), F.when(F.col("shaped"), F.col("response")).alias("_own")
        )
        read = normalize_responses(good, "_plain")
        if "shape" in prompts.columns:
            read = object_responses(read, "_own").withColumn("parse_error", F.coalesce("parse_error", "object_error")).drop("object_error")
        # Read once: results and failed nodes are both taken from the answers.
        answers = cut(read.drop("_plain", "_own"))
        errors = attempts.filter(F.col("status") == "ERROR").groupBy(*keys).agg(F.max_by("error_message", "attempt").alias("_error"))
        joined = prompts.join(answers, keys, "left").join(errors, keys, "left")
        none = F.col("result").isNull() & (F.col("object").isNull() if "object" in answers.columns else F.lit(True))
        reason = F.when(none, F.coalesce("parse_error", "_error", F.lit("no answer")))
        return joined.withColumn("failure", reason).drop("parse_error", "_error")

    return summarize
