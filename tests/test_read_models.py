"""Read models, snapshots, schedules, scalars and sinks on small tables."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logweir.functions.scalars import classify_error, json_whole_number, mask_url_credentials, run_outcome, safe_filename
from logweir.functions.text import estimate_tokens, text_units
from logweir.operators import artifacts, jobs, nodes, snapshots
from logweir.operators.cron import is_valid_cron, next_fire
from logweir.operators.ordered import with_next, with_previous
from logweir.plans.job_snapshot import snapshot_details, snapshot_entries
from logweir.sources import sinks

START = datetime(2024, 1, 1)
JOBS = "event_id string, job_id string, event_time timestamp, event_type string, job_status string, actor string, message string, payload string"
NODES = "event_id string, job_id string, node_id string, event_time timestamp, event_type string, node_status string, node_type string, level int, node_index int, attempt int, actor string, message string, payload string"


def at(seconds):
    return START + timedelta(seconds=seconds)


def job_events(spark, *events):
    rows = [(f"{i:03}", job, at(seconds), kind, status, "a", "", payload) for i, (job, seconds, kind, status, payload) in enumerate(events)]
    return spark.createDataFrame(rows, JOBS)


def node_events(spark, *events):
    rows = [
        (f"{i:03}", "j", node, at(seconds), "E", status, kind, level, index, 0, "a", "", payload)
        for i, (node, seconds, status, kind, level, index, payload) in enumerate(events)
    ]
    return spark.createDataFrame(rows, NODES)


def one(spark, expression, *values):
    fields = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([tuple(values)], fields).select(expression).first()[0]


@pytest.mark.parametrize(
    ("message", "expected"),
    [
        ("Error code: 429 - slow down", "rate_limit"),
        ("CONTEXT window: prompt too long", "context_too_long"),
        ("context lost, connection reset", "provider_unavailable"),
        ("LLM pool is busy, timeout", "llm_pool_busy"),
        ("Read timed out (500)", "timeout"),
        ("took 1500 ms", "provider_unavailable"),
        ("Schema mismatch", "schema_or_json"),
        ("odd", "unknown"),
    ],
)
def test_classify_error(spark, message, expected):
    assert one(spark, classify_error(F.col("c0")), message) == expected


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("postgres://bob:s3cret@DB.example.com:5432/x?y=1#z", "postgres://***:***@db.example.com:5432/x?y=1#z"),
        ("http://a@b@host/p", "http://***:***@host/p"),
        ("http://:pw@host", "http://***:***@host"),
        ("http://host/a@b", "http://host/a@b"),
        ("http://@host/", "http://@host/"),
        ("not a url", "not a url"),
        ("", ""),
    ],
)
def test_mask_url_credentials(spark, url, expected):
    assert one(spark, mask_url_credentials(F.col("c0")), url) == expected


def test_small_scalars(spark):
    assert one(spark, safe_filename(F.col("c0")), "..отчёт 1/а.log") == "отчёт_1_а.log"
    assert one(spark, safe_filename(F.col("c0")), "._.") == "upload"
    assert [one(spark, estimate_tokens(F.col("c0")), "x" * n) for n in (11, 12, 0)] == [5, 6, 1]
    assert one(spark, run_outcome(F.col("c0")), " Stopped ") == "FAILED"
    assert one(spark, run_outcome(F.col("c0")), "paused") == "DONE"
    found = [one(spark, json_whole_number(F.col("c0"), "$.n"), f'{{"n": {value}}}') for value in ("7", "7.0", '" 7 "', "true", "7.5", '"7.0"', "null")]
    assert found == [7, 7, 7, None, None, None, None]
    assert one(spark, text_units(F.col("c0")), " a\r\nb\r\n \r\n\r\nc   d ") == ["a\nb", "c   d"]
    assert one(spark, text_units(F.col("c0")), "a b\x0bc\xa0\n\n \x1c") == ["a", "b", "c"]
    assert one(spark, text_units(F.col("c0")), " \n\t ") == []


def test_job_state_and_lifecycle(spark):
    events = job_events(
        spark,
        ("a", 0, "JOB_CREATED", "CREATED", "{}"),
        ("a", 5, "JOB_RUNNING", "RUNNING", "{}"),
        ("a", 9, "JOB_DONE", "DONE", "{}"),
        ("a", 12, "JOB_NODE_RERUN_REQUESTED", "RUNNING", "{}"),
        ("b", 3, "JOB_CREATED", "CREATED", "{}"),
        ("b", 7, "ODD_END", "FAILED", "{}"),
        ("c", 4, "PAUSE_REQUESTED", "PAUSE_REQUESTED", "{}"),
        ("c", 4, "JOB_PAUSED", "PAUSED", "{}"),
    )
    found = {row.job_id: row for row in jobs.job_lifecycle(events).collect()}
    assert (found["a"].job_status, found["a"].started_at, found["a"].finished_at) == ("RUNNING", at(5), at(9))
    assert (found["b"].started_at, found["b"].finished_at) == (None, at(7))
    assert found["c"].last_event_type == "JOB_PAUSED" and found["c"].finished_at is None
    assert [row.job_id for row in jobs.runnable_jobs(events).collect()] == ["a"]
    assert [row.job_id for row in jobs.list_jobs(events, limit=2).collect()] == ["a", "b"]
    assert jobs.job_elapsed(events.filter("job_id = 'a'"), F.lit(at(-5)).cast("timestamp")).first().elapsed_ms == 0


def test_staged_uploads_limit_comes_before_dropping(spark):
    good = json.dumps({"source": {"filename": "f"}, "staging": {"path": "/s/f", "size_bytes": 9}})
    events = job_events(
        spark,
        ("a", 0, "FILE_STAGED", "INGESTING", good),
        ("b", 1, "FILE_STAGED", "INGESTING", '{"reused_upload": 1}'),
        ("c", 2, "FILE_STAGED", "INGESTING", "{bad"),
        ("d", 3, "FILE_STAGED", "INGESTING", good),
        ("d", 4, "INPUT_READY", "INPUT_READY", "{}"),
    )
    files = spark.createDataFrame([("/s/f",)], "path string")
    rows = jobs.staged_uploads(events, 3, files).collect()
    assert [(row.upload_id, row.job_status, row.size_bytes, row.available) for row in rows] == [("d", "INPUT_READY", 9, True)]


def test_stale_nodes_and_backlog(spark):
    states = [("RUNNING", 0), ("QUEUED", 750), ("QUEUED", 780), ("WAITING_PROVIDER", 790), ("PENDING", 0), ("DONE", 0), ("RUNNING", 300)]
    events = node_events(spark, *[(f"n{i}", seconds, status, "MAP", 0, i, "{}") for i, (status, seconds) in enumerate(states)])
    current = nodes.node_current(events)
    now = F.lit(at(790)).cast("timestamp")
    assert sorted(row.node_id for row in nodes.stale_nodes(current, now).collect()) == ["n0", "n1"]
    unknown = current.withColumn("updated_at", F.lit(None).cast("timestamp"))
    assert nodes.stale_nodes(unknown, now).count() == 5
    backlog = nodes.dispatch_backlog(current, now, concurrency=5).orderBy("position").collect()
    assert [row.node_id for row in backlog] == ["n0", "n1"]
    assert (backlog[0].ready_nodes, backlog[0].active_nodes, backlog[0].free_slots) == (3, 3, 2)
    limited = nodes.dispatch_backlog(current, now, job_limits=spark.createDataFrame([("j", 4)], "job_id string, job_limit int"))
    assert [row.node_id for row in limited.collect()] == ["n0"]


def test_two_of_seven_pending_nodes_are_selected(spark):
    events = node_events(spark, *[(f"n{i}", 0, "PENDING", "MAP", 0, i, "{}") for i in range(7)])
    backlog = nodes.dispatch_backlog(nodes.node_current(events), F.lit(at(1)).cast("timestamp"), dispatch_cap=2).collect()
    assert sorted(row.node_id for row in backlog) == ["n0", "n1"] and backlog[0].ready_nodes == 7


def test_node_links_of_two_chunks(spark):
    events = node_events(
        spark,
        ("m0", 0, "DONE", "MAP", 0, 0, '{"chunk_hash": "a"}'),
        ("m1", 0, "DONE", "MAP", 0, 1, '{"chunk_hash": "b"}'),
        ("r", 1, "PENDING", "REDUCE", 1, 0, '{"input_node_ids": ["m0", "m1"]}'),
        ("r", 9, "DONE", "REDUCE", 1, 0, '{"chunk_hash": "later but poorer"}'),
        ("f", 2, "RUNNING", "FINAL", 0, 0, '{"input_node_ids": ["r", " gone "]}'),
    )
    details = snapshot_details("j", job_events(spark, ("j", 0, "JOB_CREATED", "CREATED", "{}")), events, _artifacts(spark))
    links = [(row.from_node_id, row.from_node_type, row.to_node_id, row.input_index) for row in details["node_links"].collect()]
    assert links == [
        ("summary-source", "SOURCE", "m0", 0),
        ("summary-source", "SOURCE", "m1", 0),
        ("m0", "MAP", "r", 0),
        ("m1", "MAP", "r", 1),
        ("r", "REDUCE", "f", 0),
        ("gone", "", "f", 1),
    ]
    assert {row.node_status: row.nodes_count for row in details["node_counts"].collect()} == {"DONE": 3, "RUNNING": 1}


def test_lists_of_all_jobs_agree_with_those_of_one(spark):
    events = node_events(spark, *[(f"n{i}", i, "DONE" if i % 2 else "PENDING", "MAP", 0, i, "{}") for i in range(6)])
    created = job_events(spark, ("j", 0, "JOB_CREATED", "CREATED", "{}"))
    one, rows = snapshot_details("j", created, events, _artifacts(spark)), snapshot_entries(created, events, _artifacts(spark), node_limit=4).collect()
    of = lambda name: [row for row in rows if row.list == name]
    assert {row.item_id for row in of("nodes")} == {row.node_id for row in one["nodes"].collect()}
    assert {(row.name, row.counted) for row in of("artifact_counts")} == {(row.artifact_type, row.artifacts_count) for row in one["artifact_counts"].collect()}
    assert {row.item_id for row in of("artifacts")} == {row.artifact_id for row in one["artifacts"].collect()}
    assert sorted(row.position for row in of("node_events")) == [1, 2, 3, 4] and len(of("job_events")) == 1
    assert {(row.item_id, row.name) for row in of("node_links")} == {("summary-source", f"n{i}") for i in range(6)}


def _artifacts(spark):
    fields = "artifact_id string, job_id string, node_id string, artifact_type string, stage string, level int, content_hash string, content string, metadata string, created_at timestamp"
    return spark.createDataFrame(
        [
            ("1", "j", "m0", "MAP_SUMMARY", "MAP", 0, "h", "old", "{}", at(1)),
            ("2", "j", "m0", "MAP_SUMMARY", "MAP", 0, "h", "new", "{}", at(1)),
            ("3", "j", "m1", "CHUNK", "CHUNK", 0, "h", "c", "{}", at(2)),
        ],
        fields,
    )


def test_artifact_reads(spark):
    table = _artifacts(spark)
    newest = artifacts.latest_artifacts(table, artifact_type="MAP_SUMMARY").collect()
    assert [row.content for row in newest] == ["new"]
    assert "content" not in artifacts.list_artifacts(table).columns
    maps = spark.createDataFrame([("j", "m0"), ("j", "m1")], "job_id string, node_id string")
    assert [row.node_id for row in artifacts.skip_done(maps, table, "MAP_SUMMARY").collect()] == ["m1"]


def test_neighbours_across_partitions(spark):
    rows = [("hot" if i % 10 else f"k{i}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, pos long").repartition(6)
    before = {row.pos: row.before for row in with_previous(df, "k", ["pos"], {"before": F.col("pos")}).collect()}
    after = {row.pos: row.after for row in with_next(df, "k", ["pos"], {"after": F.col("pos")}).collect()}
    for key in {key for key, _ in rows}:
        own = [pos for name, pos in rows if name == key]
        assert [before[pos] for pos in own] == [None, *own[:-1]]
        assert [after[pos] for pos in own] == [*own[1:], None]


def fire(spark, cron, zone, after):
    df = spark.createDataFrame([(cron, zone, after)], "c string, z string, a timestamp")
    return next_fire(df, "c", "z", "a").first().next_fire_at


@pytest.mark.parametrize(
    ("cron", "zone", "after", "expected"),
    [
        ("*/15 * * * *", "UTC", datetime(2024, 1, 1, 0, 0), datetime(2024, 1, 1, 0, 15)),
        ("*/15 * * * *", "UTC", datetime(2024, 1, 1, 0, 14, 59), datetime(2024, 1, 1, 0, 15)),
        ("0 9 * * mon-fri", "Europe/Berlin", datetime(2024, 3, 29, 12), datetime(2024, 4, 1, 7)),
        ("0 0 29 2 *", "UTC", datetime(2024, 3, 1), datetime(2028, 2, 29)),
        ("0 0 13 * 5", "", datetime(2024, 9, 1), datetime(2024, 9, 6)),
        ("@monthly", "UTC", datetime(2024, 1, 1), datetime(2024, 2, 1)),
        ("0 12 1-7 * *", "America/New_York", datetime(2024, 1, 7, 17), datetime(2024, 2, 1, 17)),
        # 02:30 does not exist in Berlin on 31 March 2024.
        ("30 2 * * *", "Europe/Berlin", datetime(2024, 3, 30, 12), datetime(2024, 4, 1, 0, 30)),
        # 02:30 happens twice in Berlin on 27 October 2024.
        ("30 2 * * *", "Europe/Berlin", datetime(2024, 10, 26, 12), datetime(2024, 10, 27, 0, 30)),
        ("30 2 * * *", "Europe/Berlin", datetime(2024, 10, 27, 0, 45), datetime(2024, 10, 27, 1, 30)),
        ("15 * * * *", "Australia/Lord_Howe", datetime(2024, 4, 6, 14, 50), datetime(2024, 4, 6, 15, 45)),
    ],
)
def test_next_fire(spark, cron, zone, after, expected):
    assert fire(spark, cron, zone, after) == expected


@pytest.mark.parametrize(
    ("cron", "valid"),
    [("* * * * *", True), ("0-59/7 */2 1,15 jan-mar 7", True), ("60 * * * *", False), ("* * *", False), ("a * * * *", False), ("5-1 * * * *", False), ("@daily", True), ("* * * * * *", False)],
)
def test_is_valid_cron(spark, cron, valid):
    assert one(spark, is_valid_cron(F.col("c0")), cron) is valid


def test_tick_report(spark):
    profile = "snapshot_id string, profile_id string, name string, is_archived boolean, created_at timestamp, updated_at timestamp"
    profiles = spark.createDataFrame(
        [("1", "run", "n", False, at(0), at(0)), ("1", "old", "n", False, at(0), at(0)), ("2", "old", "n", True, at(1), at(1)), ("1", "busy", "n", False, at(0), at(0))],
        profile,
    )
    schedule = "snapshot_id string, profile_id string, cron string, timezone string, is_enabled boolean, max_active_runs int, next_run_at timestamp, last_run_at timestamp, created_at timestamp, updated_at timestamp"
    due = [(name, at(10)) for name in ("run", "old", "busy", "unknown")] + [("later", at(10**6))]
    schedules = spark.createDataFrame([("1", name, "*/5 * * * *", "UTC", True, 0, when, None, at(0), at(0)) for name, when in due], schedule)
    runs = spark.createDataFrame(
        [("1", "r1", "busy", "RUNNING", at(1)), ("1", "r2", "run", "RUNNING", at(1)), ("2", "r2", "run", "DONE", at(2))],
        "snapshot_id string, run_id string, profile_id string, status string, updated_at timestamp",
    )
    report = {row.profile_id: row for row in snapshots.tick_report(profiles, schedules, runs, F.lit(at(20)).cast("timestamp")).collect()}
    assert {name: (row.action, row.detail) for name, row in report.items()} == {
        "run": ("launched", ""),
        "old": ("skipped", "profile_missing_or_archived"),
        "unknown": ("skipped", "profile_missing_or_archived"),
        "busy": ("skipped", "max_active_runs_reached"),
    }
    assert report["run"].last_run_at == at(10) and report["busy"].last_run_at is None
    assert report["run"].advanced_next_run_at == datetime(2024, 1, 1, 0, 5)


def test_appends_and_replays(spark, tmp_path):
    root = str(tmp_path)
    events = spark.createDataFrame([("j", at(0), "E", "RUNNING", "a", "", {"b": "1", "a": "2"})], "job_id string, event_time timestamp, event_type string, job_status string, actor string, message string, payload map<string,string>")
    for _ in range(2):
        sinks.append_events(events, root, "job_events")
    rows = spark.read.parquet(f"{root}/job_events").collect()
    assert len(rows) == 2 and len({row.event_id for row in rows}) == 1
    assert rows[0].payload == '{"a":"2","b":"1"}'
    segments = spark.createDataFrame([("j", i, "h", "text", 3) for i in range(5)], "job_id string, segment_index int, content_hash string, content string, rows_count int")
    assert sinks.append_segments(segments, root, F.lit(at(0))) == {"segments": 5, "rows": 15}


def test_a_whole_run_from_files_to_tables(spark, tmp_path):
    """Read, segment, summarise, store, judge: the parts fit together."""
    from logweir.functions.records import accepted
    from logweir.operators.calls import latest_calls
    from logweir.operators.segments import segment_rows
    from logweir.plans.tree import summarize_segments
    from logweir.sources.files import read_logs

    (tmp_path / "in").mkdir()
    for name in ("a.log", "b.log"):
        (tmp_path / "in" / name).write_text("".join(f"{name} line {i} {'x' * 50}\n" for i in range(60)))
    records = accepted(read_logs(spark, str(tmp_path / "in")))
    segments = segment_rows(records, "source_id", ["block", "line"], 256).withColumnRenamed("source_id", "job_id")
    final = summarize_segments(segments, max_group=3).collect()
    assert len(final) == 2 and all(json.loads(row.content)["summary"].startswith("[FINAL]") for row in final)

    root = str(tmp_path / "tables")
    stored = spark.createDataFrame(
        [(row.job_id, row.node_id, "FINAL_SUMMARY", "FINAL", 0, row.content, "{}") for row in final],
        "job_id string, node_id string, artifact_type string, stage string, level int, content string, metadata string",
    )
    sinks.append_artifacts(stored, root, F.lit(at(0)))
    assert artifacts.latest_artifacts(spark.read.parquet(f"{root}/artifacts")).count() == 2

    calls = spark.createDataFrame(
        [("1", "j", "n", at(0), "{}", ""), ("2", "j", "n", at(1), "", "x")],
        "call_id string, job_id string, node_id string, created_at timestamp, request_json string, response_json string",
    )
    sinks.append_llm_calls(calls, root)
    newest = latest_calls(spark.read.parquet(f"{root}/llm_calls")).first()
    assert (newest.call_id, newest.request_hash, len(newest.response_hash)) == ("2", "", 64)


def test_results_are_kept_or_discarded(spark):
    events = job_events(spark, ("j", 0, "JOB_RUNNING", "RUNNING", "{}"))
    states = node_events(spark, ("n1", 0, "RUNNING", "MAP", 0, 0, "{}"), ("n2", 0, "PAUSED", "MAP", 0, 1, "{}"))
    given = spark.createDataFrame([("j", "n1"), ("j", "n2")], "job_id string, node_id string")
    judged = artifacts.judge_results(given, events, states)
    assert [row.node_id for row in artifacts.accepted_results(judged).collect()] == ["n1"]
    assert [(row.node_id, row.discard_reason) for row in artifacts.discarded_results(judged).collect()] == [("n2", "node_status_changed")]
    assert [row.node_id for row in nodes.list_nodes(states, "j").collect()] == ["n1", "n2"]
