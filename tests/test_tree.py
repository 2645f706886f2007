"""The summarisation tree, prompts, responses and schemas."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from logweir.functions import prompts
from logweir.functions.responses import normalize_responses
from logweir.functions.schemas import schema_of_examples
from logweir.functions.summaries import dry_key_points, dry_summary, json_text, with_body
from logweir.functions.text import LINE_BREAK, SPACE_CLASS
from logweir.plans import summarizers, tree


def segments(spark, rows):
    df = spark.createDataFrame(rows, "job_id string, segment_index long, content string")
    return df.withColumn("content_hash", F.sha2("content", 256)).withColumn("rows_count", F.lit(1))


def mapped(spark, rows, **options):
    return tree.map_summarize(tree.create_map_nodes(segments(spark, rows)), **options)


def test_five_chunks_in_groups_of_two(spark):
    outputs = mapped(spark, [("j", i, f"chunk-{i + 1}") for i in range(5)] + [("single", 0, "only")])
    tops, levels = tree.reduce_tree(outputs, max_group=2)
    ranges = sorted((row.level, row.seq_start, row.seq_end) for row in levels.collect())
    assert ranges == [(1, 0, 1), (1, 2, 3), (1, 4, 4), (2, 0, 3), (2, 4, 4), (3, 0, 4)]
    index = {row.node_id: row.node_index for row in outputs.filter("job_id = 'j'").collect()}
    first = levels.filter("level = 1").orderBy("node_index").collect()
    assert [[index[node] for node in row.input_node_ids] for row in first] == [[0, 1], [2, 3], [4]]
    final = tree.finalize(tops).collect()
    assert sorted(row.job_id for row in final) == ["j", "single"]
    assert all(json.loads(row.content)["ok"] for row in final)


def test_forced_progress_when_every_summary_is_too_large(spark):
    def large(prompts_df):
        body = F.struct(
            F.lit(True).alias("ok"), F.repeat(F.lit("large "), 200).alias("summary"),
            F.array().cast("array<string>").alias("key_points"), F.array().cast("array<string>").alias("warnings"),
            F.lit(1).alias("source_count"),
        )
        return prompts_df.withColumn("result", body)

    outputs = mapped(spark, [("j", i, f"chunk-{i}") for i in range(4)], summarizer=large)
    _, levels = tree.reduce_tree(outputs, large, max_group=2, budget=256)
    rows = levels.collect()
    assert sorted((row.level, row.input_count) for row in rows) == [(1, 2), (1, 2), (2, 2)]
    assert {row.grouping_strategy for row in rows} == {"forced_progress"}


def test_own_prompts_and_report_format_of_a_job(spark):
    metadata = {
        "report_format": "executive_summary",
        "prompt_overrides": {"map": {"user": "Look at {chunk}!"}, "reduce": {"system": "R"}, "final": {"system": " "}},
    }
    jobs = spark.createDataFrame([("j", json.dumps(metadata))], "job_id string, metadata string")
    asked = []

    def watch(prompts_df):
        asked.extend(prompts_df.select("job_id", "stage", "system", "user").collect())
        return summarizers.dry_summarizer(prompts_df)

    outputs = mapped(spark, [("j", 0, "a"), ("j", 1, "b"), ("k", 0, "c")], summarizer=watch, settings=jobs)
    tops, _ = tree.reduce_tree(outputs, watch, settings=jobs)
    final = {row.job_id: row for row in tree.finalize(tops, watch, jobs).collect()}
    said = {(row.job_id, row.stage): row for row in asked}
    assert said["j", "MAP"].user in ("Look at a!", "Look at b!")
    assert said["k", "MAP"].user == "Summarize this chunk:\n\nc"
    assert said["j", "REDUCE_L1"].system == "R"
    assert prompts.REPORT_FORMATS["executive_summary"] in said["j", "FINAL"].user
    assert said["j", "FINAL"].system == prompts.SYSTEM_TEXT["final"]
    assert final["j"].report_format == "executive_summary" and final["k"].report_format is None


def test_calls_are_retried_and_recorded(spark, tmp_path):
    folder = str(tmp_path)

    def flaky(stage, system, user):
        import os

        mark = os.path.join(folder, str(abs(hash(user)) % 10**9))
        tried = os.path.exists(mark)
        open(mark, "w").close()
        if "never" in user:
            raise RuntimeError("HTTP 429")
        if not tried:
            raise RuntimeError("Request timed out")
        return json.dumps({"answer": f"seen {user[-1]}"})

    seen = []
    summarize = summarizers.callable_summarizer(
        flaky, max_calls=2, retries=2, backoff_seconds=0.0, on_attempts=lambda attempts, asked: seen.append((attempts, asked))
    )
    outputs = mapped(spark, [("j", 0, "a"), ("j", 1, "b"), ("j", 2, "never")], summarizer=summarize).collect()
    assert sorted(json.loads(row.content)["summary"] for row in outputs) == ["seen a", "seen b"]
    # The job of the node that failed has no final report; its neighbour has.
    segments = spark.createDataFrame(
        [("j", 0, "a", "h0", 1), ("j", 1, "b", "h1", 1), ("j", 2, "never", "h2", 1), ("k", 0, "c", "h3", 1)],
        "job_id string, segment_index int, content string, content_hash string, rows_count int",
    )
    final, failed = tree.summarize_jobs(segments, summarize)
    assert [row.job_id for row in final.collect()] == ["k"]
    assert [(row.job_id, row.stage, row.reason) for row in failed.collect()] == [("j", "MAP", "HTTP 429")]
    calls = summarizers.call_rows(*seen[0], "local", "m").collect()
    errors = sorted((row.node_id, row.attempt, row.error_class) for row in calls if row.status == "ERROR")
    assert sorted(kind for _, _, kind in errors) == ["rate_limit"] * 3 + ["timeout"] * 2
    assert len(calls) == 7 and len({row.call_id for row in calls}) == 7


def test_waves_cap_the_calls_in_flight(spark, tmp_path):
    folder = str(tmp_path)

    def slow(stage, system, user):
        import os
        import time

        mine = os.path.join(folder, f"call-{user}")
        open(mine, "w").close()
        flying = len([name for name in os.listdir(folder) if name.startswith("call-")])
        time.sleep(0.02)
        os.unlink(mine)
        open(os.path.join(folder, f"asked-{user}-{time.time_ns()}"), "w").close()
        return json.dumps({"summary": str(flying)})

    prompts = spark.range(60).selectExpr("'j' AS job_id", "CAST(id AS STRING) AS node_id", "'MAP' AS stage", "'' AS system", "CAST(id AS STRING) AS user")
    attempts = summarizers.retry_calls(prompts, slow, max_calls=2, retries=0, task_prompts=5)
    rows = attempts.collect()
    assert sorted(int(row.node_id) for row in rows) == list(range(60)) and attempts.count() == 60
    assert max(int(json.loads(row.response)["summary"]) for row in rows) <= 2
    # Read twice, asked once.
    assert len([name for name in tmp_path.iterdir() if name.name.startswith("asked-")]) == 60


def test_the_head_of_a_prompt_gives_what_the_whole_text_gives(spark):
    import random

    draw = random.Random(3)
    parts = ["word", " ", "\u3000", "\x85", "\n", "\r\n", "\t ", "é", "\U0001f600", "long" * 30, " " * 500, "\n" * 14, "\x1c", "-"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.choice([0, 3, 30, 120]))) for _ in range(300)]
    # All of the first lines blank, and all of the first characters.
    texts += ["\n \n" * 20 + "a\nb", " " * 700 + "tail", "x " * 210, "x " * 211, "y" * 419 + "  z", "y" * 420 + "  z"]
    found = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", dry_summary(F.lit("MAP"), F.col("text")).alias("summary"), dry_key_points(F.col("text")).alias("points"))
    for row in found.collect():
        flat = " ".join(re.sub(f"[{SPACE_CLASS}]+", " ", texts[row.id]).split(" ")).strip(" ")
        assert row.summary == "[MAP] " + (flat if len(flat) <= 420 else flat[:420].rstrip(" ") + "..."), texts[row.id]
        lines = [re.sub(f"[{SPACE_CLASS}]+", " ", line).strip(" ") for line in re.split(LINE_BREAK, texts[row.id])]
        assert row.points == [line for line in lines if line][:5], texts[row.id]
    # Only the first lines are split off.
    assert ", 13)" in found._jdf.queryExecution().optimizedPlan().toString()


def test_waves_of_fast_calls_grow(spark):
    prompts = spark.range(800).selectExpr("'j' AS job_id", "CAST(id AS STRING) AS node_id", "'MAP' AS stage", "'' AS system", "CAST(id AS STRING) AS user")
    attempts = summarizers.retry_calls(prompts, lambda stage, system, user: json.dumps({"summary": user}), max_calls=2, retries=0, task_prompts=10)
    assert sorted((int(row.node_id), json.loads(row.response)["summary"]) for row in attempts.collect()) == sorted((id, str(id)) for id in range(800))
    # Waves of a fixed size were 40, each with a file a task.
    assert len(attempts.inputFiles()) <= 20


def test_waves_that_take_long_stay_small():
    least, half = 100, summarizers.WAVE_SECONDS / 2
    assert summarizers.next_width(100, least, half - 1) == 200
    assert summarizers.next_width(200, least, half + 1) == 200
    assert summarizers.next_width(200, least, 2 * half + 1) == 100
    assert summarizers.next_width(100, least, 100 * half) == 100


@pytest.mark.parametrize(
    ("response", "expected"),
    [
        ('```json\n{"summary":"ok","key_points":["a"],"warnings":[],"source_count":2}\n```', (True, "ok", ["a"], [], 2)),
        ('{"ok":false,"summary":"s","key_points":[],"warnings":["w"],"source_count":0}', (False, "s", [], ["w"], 1)),
        ('Sure: {"result": "r", "sourceCount": "4", "warnings": "one"} bye', (True, "r", [], ["one"], 4)),
        ('{"summary": {"text": "inner", "key_points": [{"content": "p"}, "q", ""]}}', (True, "inner", ["p", "q"], [], 1)),
        ('["a", {"b": 1}]', (True, '[\n  "a",\n  {\n    "b": 1\n  }\n]', [], [], 1)),
        (
            '{"cause_of_it": "Disk  full", "seen_on": {"host_name": "h7", "tries": [2]}, "done": ["wait", 3, true]}',
            (
                True,
                "Cause of it: Disk full\nSeen on:\n- host name: h7\n- tries: [2]\nDone:\n- wait\n- 3\n- True",
                ["cause of it: Disk full", 'seen on: {"host_name": "h7", "tries": [2]}', 'done: ["wait", 3, true]'],
                [],
                1,
            ),
        ),
        ('text {"summary": "a } b"} and {"x": 1}', (True, "a } b", [], [], 1)),
    ],
)
def test_responses(spark, response, expected):
    row = normalize_responses(spark.createDataFrame([(response,)], "r string"), "r").first()
    assert tuple(row.result) == expected and row.parse_error is None


def test_response_without_json(spark):
    rows = normalize_responses(spark.createDataFrame([("no json here",), ("",)], "r string"), "r").collect()
    assert all(row.result is None and "JSON" in row.parse_error for row in rows)


def test_reduce_input_bodies(spark):
    contents = [
        '{"ok": true, "summary": "s", "key_points": ["a", "b"], "warnings": [], "source_count": 1}',
        '{"b": 1, "a": [1, "é"]}',
        "  plain text ",
        "[1, 2]",
        '{"ok": true, "summary": "s", "key_points": [], "warnings": [], "source_count": 1, "more": 1}',
        "3",
    ]
    rows = with_body(spark.createDataFrame(list(enumerate(contents)), "i long, content string")).orderBy("i").collect()
    assert [row.body.rstrip("\n") for row in rows] == [
        "s\n- a\n- b",
        '{\n  "b": 1,\n  "a": [\n    1,\n    "é"\n  ]\n}',
        "plain text",
        "[\n  1,\n  2\n]",
        json.dumps(json.loads(contents[4]), indent=2),
        "3",
    ]


def test_json_text_matches_a_json_writer(spark):
    texts = ['plain', 'quote " slash / back \\ tab \t', "esc \x1b[0m and \\u001B", "\x0e\x0f\x1a\x00", "é\U0001f600", "\\\\\x1b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", json_text(F.col("t")).alias("j"))
    assert {row.i: row.j for row in rows.collect()} == {i: json.dumps(text, ensure_ascii=False) for i, text in enumerate(texts)}


@pytest.mark.parametrize(
    ("example", "properties"),
    [
        ({"title": "string: short title", "n": "Number", "ok": True, "tags": ["integer - id"], "x": 1.5, "e": [], "free": "any words"},
         {"title": {"type": "string", "description": "short title"}, "n": {"type": "number"}, "ok": {"type": "boolean"},
          "tags": {"type": "array", "items": {"type": "integer", "description": "id"}}, "x": {"type": "number"},
          "e": {"type": "array", "items": {"type": "string"}}, "free": {"type": "string", "description": "any words"}}),
        ({"type": "array", "items": {"type": "string"}}, {"value": {"type": "array", "items": {"type": "string"}}}),
        ({"$schema": "x", "properties": {"a": {"type": "object", "properties": {"b": "string"}}, "c": "string: why"}},
         {"a": {"type": "object", "properties": {"b": {"type": "string"}}, "required": ["b"], "additionalProperties": False},
          "c": {"type": "string", "description": "why"}}),
    ],
)
def test_schema_of_examples(spark, example, properties):
    df = spark.createDataFrame([(json.dumps(example),), ("no json",), (None,)], "e string")
    found, *others = [row.json_schema for row in schema_of_examples(df, "e", "json_schema").collect()]
    schema = json.loads(found)
    assert schema["properties"] == properties and schema["type"] == "object"
    assert schema["required"] == list(properties) and schema["additionalProperties"] is False
    assert others == [None, None]


def test_salted_totals_give_the_same_groups(spark, monkeypatch):
    rows = [("hot", i, f"chunk {i} " + "word " * (i % 60)) for i in range(120)]
    rows += [(f"j{i % 9}", i // 9, f"c{i}") for i in range(40)]
    outputs = mapped(spark, rows).cache()
    few = tree.group_reduce_inputs(outputs, tree.ORDER, 4, 600).select("job_id", "node_id", "group_index", "inputs_count", "grouping_strategy")
    few = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(tree, "BROADCAST_JOBS", 0)
    many = tree.group_reduce_inputs(outputs, tree.ORDER, 4, 600).select("job_id", "node_id", "group_index", "inputs_count", "grouping_strategy")
    assert sorted(map(tuple, many.collect())) == few
    outputs.unpersist()


def test_output_shape_of_a_job_enters_its_prompts(spark):
    metadata = {
        "metadata": {
            "intermediate_output_json_schema": {"finding": "string: what"},
            "output_json_schema": json.dumps({"answer": "number"}),
            "report_format": "markdown",
        }
    }
    fields = "artifact_id string, job_id string, artifact_type string, metadata string, created_at string"
    inputs = spark.createDataFrame([("1", "j", "INPUT", "{}", "a"), ("2", "j", "INPUT", json.dumps(metadata), "b")], fields)
    asked = []

    def watch(prompts_df):
        asked.extend(prompts_df.select("job_id", "stage", "system", "user").collect())
        return summarizers.dry_summarizer(prompts_df)

    settings = tree.job_settings(inputs)
    outputs = mapped(spark, [("j", 0, "a"), ("j", 1, "b"), ("k", 0, "c")], summarizer=watch, settings=settings)
    tops, _ = tree.reduce_tree(outputs, watch, settings=settings)
    tree.finalize(tops, watch, settings).collect()
    said = {(row.job_id, row.stage): row for row in asked}
    schema = {
        "type": "object",
        "properties": {"finding": {"type": "string", "description": "what"}},
        "required": ["finding"],
        "additionalProperties": False,
    }
    for stage, key in (("map", "MAP"), ("reduce", "REDUCE_L1")):
        assert said["j", key].system == prompts.SHAPED_SYSTEM_TEXT[stage]
        assert json.dumps(schema, indent=2) in said["j", key].user
    assert said["k", "MAP"].system == prompts.SYSTEM_TEXT["map"] and "structure" not in said["k", "MAP"].user
    final = said["j", "FINAL"]
    assert final.system == prompts.SHAPED_SYSTEM_TEXT["final"] and '"answer"' in final.user
    assert prompts.REPORT_FORMATS["markdown"] in final.user and said["k", "FINAL"].user.startswith("Create the final user-facing report")


def test_answers_of_an_own_shape_are_kept(spark):
    wanted = {"intermediate_output_json_schema": {"b": "string"}, "output_json_schema": {"b": "string"}}
    fields = "artifact_id string, job_id string, artifact_type string, metadata string, created_at string"
    settings = tree.job_settings(spark.createDataFrame([("1", job, "INPUT", json.dumps({"metadata": wanted}), "a") for job in "jl"], fields))
    segments = spark.createDataFrame(
        [("j", 0, "a", "h0", 1), ("j", 1, "b", "h1", 1), ("k", 0, "c", "h2", 1), ("l", 0, "list", "h3", 1)],
        "job_id string, segment_index int, content string, content_hash string, rows_count int",
    )

    def answer(stage, system, user, shape=None):
        if "list" in user.split():
            return '["no object"]'
        if shape is None:
            return '{"summary": "plain"}'
        assert json.loads(shape)["required"] == ["b"]
        return 'Here: {"z": 1.50, "b": "' + stage + ' \\u00e4", "ok": []} done'

    summarize = summarizers.callable_summarizer(answer, max_calls=2, retries=0)
    outputs = {row.node_id: row for row in tree.map_summarize(tree.create_map_nodes(segments), summarize, settings).collect()}
    own = [row for row in outputs.values() if row.job_id == "j"]
    assert {row.content for row in own} == {'{\n  "z": 1.5,\n  "b": "MAP ä",\n  "ok": []\n}'}
    assert all(row.body.strip() == row.content for row in own) and len({row.content_hash for row in own}) == 1
    final, failed = tree.summarize_jobs(segments, summarize, settings=settings)
    told = {row.job_id: json.loads(row.content) for row in final.collect()}
    assert told["j"] == {"z": 1.5, "b": "FINAL ä", "ok": []} and told["k"]["summary"] == "plain" and set(told) == {"j", "k"}
    assert [(row.job_id, row.stage, row.reason) for row in failed.collect()] == [("l", "MAP", "the JSON of the answer is no object")]


@pytest.mark.parametrize(
    ("response", "summary", "count"),
    [
        ('{"summary": "a", "source_count": 1e999}', "a", None),
        ('{"summary": "a", "source_count": 99999999999}', "a", 2**31 - 1),
        ('{"summary": "cut \\ud83d"}', "cut ?", 1),
        ("[" * 100_000, None, None),
        ('{"a":' * 100_000, None, None),
        ('{"summary": "' + "x\\n" * 20_000 + '"}', "x\n" * 20_000, 1),
        ("", None, None),
    ],
)
def test_odd_responses_end_no_job(spark, response, summary, count):
    row = normalize_responses(spark.createDataFrame([(response,), (None,)], "r string"), "r").filter("r is not null").first()
    assert (row.result.summary if row.result else None) == summary
    assert (row.parse_error is None) == (summary is not None)
    assert count is None or row.result.source_count == count


def test_given_schemas_keep_the_order_of_their_keys(spark):
    given = '{"properties": {"a": "string"}}'
    row = schema_of_examples(spark.createDataFrame([(given,)], "e string"), "e").first()
    assert row.json_schema == (
        '{"properties": {"a": {"type": "string"}}, "type": "object", "required": ["a"], "additionalProperties": false}'
    )


SHAPES = [
    # A nested example: names are trimmed, empty ones dropped, lists go by their first item, empty ones are of texts.
    (
        {" a ": {"b": [{"c": "Integer - how many"}], "d": []}, " ": 1, "e": [[True]], "f": None, "g": "stringy", "h": 1.5},
        {
            "a": {
                "b": {"type": "array", "items": {"c": {"type": "integer", "description": "how many"}}},
                "d": {"type": "array", "items": {"type": "string"}},
            },
            "e": {"type": "array", "items": {"type": "array", "items": {"type": "boolean"}}},
            "f": {"type": "string"},
            "g": {"type": "string", "description": "y"},
            "h": {"type": "number"},
        },
    ),
]


def strict(shape):
    """Objects of a shape written out with all that is filled in."""
    if isinstance(shape, dict) and not isinstance(shape.get("type"), str):
        inner = {key: strict(value) for key, value in shape.items()}
        return {"type": "object", "properties": inner, "required": list(inner), "additionalProperties": False}
    return {**shape, "items": strict(shape["items"])} if "items" in shape else shape


@pytest.mark.parametrize(
    ("example", "wanted"),
    [(example, json.dumps(strict(shape))) for example, shape in SHAPES]
    + [
        # What a schema gives stays as it is and where it is.
        (
            {"$schema": "x", "title": 'a "b": c, d', "properties": {"p": {"type": "array", "minItems": 1}, " ": 1, "q": ["boolean: yes"]}, "required": ["p"], "z": [1, {"y": None}]},
            '{"title": "a \\"b\\": c, d", "properties": {"p": {"type": "array", "minItems": 1, "items": {"type": "string"}}, '
            '"q": {"type": "array", "items": {"type": "boolean", "description": "yes"}}}, "required": ["p"], "z": [1, {"y": null}], "type": "object", "additionalProperties": false}',
        ),
        ({"type": "string", "enum": ["a", "b"]}, '{"type": "object", "properties": {"value": {"type": "string", "enum": ["a", "b"]}}, "required": ["value"], "additionalProperties": false}'),
        ({"$schema": "x"}, '{"type": "object", "additionalProperties": false}'),
        ({"type": "object"}, '{"type": "object", "additionalProperties": false}'),
        ({"properties": 3}, '{"properties": 3, "type": "object", "additionalProperties": false}'),
        (
            {"type": "array", "items": {"k": "v"}, "x": 1},
            json.dumps({"type": "object", "properties": {"value": {"type": "array", "items": strict({"k": {"type": "string", "description": "v"}}), "x": 1}}, "required": ["value"], "additionalProperties": False}),
        ),
        ({"type": "object", "properties": {"p": {"type": "integer"}, "q": {"properties": {}}, "r": {"$schema": "only"}}}, None),
    ],
)
def test_schemas_of_nested_examples(spark, example, wanted):
    if wanted is None:
        wanted = (
            '{"type": "object", "properties": {"p": {"type": "integer"}, "q": {"properties": {}, "type": "object", "required": [], "additionalProperties": false}, '
            '"r": {}}, "required": ["p", "q", "r"], "additionalProperties": false}'
        )
    df = spark.createDataFrame([(json.dumps(example),)] * 2 + [("[1]",), ("{}",)], "e string")
    found = [row.json_schema for row in schema_of_examples(df, "e").collect()]
    assert sorted(filter(None, found)) == [wanted] * 2 and len(found) == 4


def test_schemas_of_deep_examples(spark):
    deep, wanted = "integer", {"type": "integer"}
    for _ in range(12):
        deep, wanted = {"k": [deep]}, strict({"k": {"type": "array", "items": wanted}}) if "properties" not in wanted else {
            "type": "object", "properties": {"k": {"type": "array", "items": wanted}}, "required": ["k"], "additionalProperties": False
        }
    assert schema_of_examples(spark.createDataFrame([(json.dumps(deep),)], "e string"), "e").first().json_schema == json.dumps(wanted)
