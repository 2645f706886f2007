"""Streams run to the end of their input and are compared with the batch operators."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from logweir.operators import jobs, nodes
from logweir.sources import commits
from logweir.streaming import ingest, kept, results, stale, state

START = datetime(2024, 1, 1)
JOB_FIELDS = "event_id string, job_id string, event_time timestamp, event_type string, job_status string, actor string, message string, payload string"
NODE_FIELDS = "event_id string, job_id string, node_id string, event_time timestamp, event_type string, node_status string, node_type string, level int, node_index int, attempt int, actor string, message string, payload string"


@pytest.fixture
def logs(spark, tmp_path):
    rng = random.Random(5)
    job_rows, node_rows = [], []
    for i in range(400):
        job = f"j{rng.choice([0, 0, 0, 0, 1, 2, 3])}"
        at = START + timedelta(seconds=rng.randint(0, 200))
        job_rows.append((f"{i:06}", job, at, f"E{rng.randint(0, 4)}", rng.choice(["RUNNING", "DONE", "PAUSED"]), "a", "", "{}"))
        node_rows.append((f"{i:06}", job, f"n{rng.randint(0, 20)}", at, "NODE", rng.choice(["RUNNING", "DONE", "QUEUED"]), "MAP", 0, i, 0, "a", "", "{}"))
    for part in range(4):
        spark.createDataFrame(job_rows[part::4], JOB_FIELDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "jobs"))
        spark.createDataFrame(node_rows[part::4], NODE_FIELDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "nodes"))
    return tmp_path


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(writer, tmp_path, name):
    query = writer.option("checkpointLocation", str(tmp_path / f"checkpoint-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None and not query.isActive


def same(left, right):
    names = sorted(left.columns)
    assert names == sorted(right.columns)
    assert sorted(map(repr, left.select(*names).collect())) == sorted(map(repr, right.select(*names).collect()))


def test_current_state_equals_the_batch_read(spark, logs):
    out = str(logs / "state")
    run(state.stream_current_state(stream(spark, logs / "jobs", JOB_FIELDS), out), logs, "jobs")
    expected = jobs.job_current(spark.read.parquet(str(logs / "jobs")))
    same(state.read_current_state(spark, out), expected)
    state.compact_state(spark, out, str(logs / "compacted"))
    same(state.read_current_state(spark, str(logs / "compacted")), expected)


def test_state_holds_open_jobs_only_and_replays_to_the_same(spark, tmp_path):
    def batch(rows):
        return spark.createDataFrame([(f"{i:03}", job, START + timedelta(seconds=i), "E", status, "a", "", "{}") for i, job, status in rows], JOB_FIELDS)

    batches = [
        [(1, "a", "RUNNING"), (2, "b", "RUNNING"), (3, "c", "RUNNING")],
        [(4, "a", "DONE"), (5, "b", "PAUSED")],
        [(6, "c", "FAILED"), (7, "b", "CANCELLED")],
        # An event after the end, and one that came late.
        [(8, "a", "RUNNING"), (0, "c", "CREATED")],
    ]
    out, seen, sizes = str(tmp_path / "state"), [], []
    states = {}
    for number, rows in enumerate(batches):
        seen += rows
        for _ in range(2):
            # The second time is a replay of the same batch.
            state.stream_current_state(stream_of(batch(rows), number, states), out)
            states[number]()
            same(state.read_current_state(spark, out), jobs.job_current(batch(seen)))
        left = kept.before(spark, out, number + 1, state.OPEN_PART)
        sizes.append(left.count() if left is not None else 0)
    # The fourth batch opens "a" anew; a late event of "c" is one of a job that is not over yet, as far as it tells.
    assert sizes == [3, 2, 0, 2]
    assert sorted(name for name in kept.names(spark, out) if "=" in name and kept.exists(spark, f"{out}/{name}{state.OPEN_PART}")) == ["batch_id=3"]


class stream_of:
    """Stands for a stream of one batch: what is given to ``foreachBatch`` is kept to be called."""

    def __init__(self, batch, number, calls):
        self.batch, self.number, self.calls, self.writeStream = batch, number, calls, self

    def foreachBatch(self, store):
        self.calls[self.number] = lambda: store(self.batch, self.number)


def test_changed_snapshots_over_batches(spark, tmp_path):
    fields = "job_id string, at long, content string"
    batches = [
        [("j", 1, "A"), ("j", 2, "A"), ("k", 1, "A")],
        [("j", 3, "B"), ("j", 4, "A"), ("k", 2, "A"), ("j", 2, "late")],
        [("j", 5, "A"), ("k", 3, "B"), (None, 1, "A")],
        [("j", 6, None), ("j", 7, None), (None, 2, "A")],
    ]
    calls = {}
    for number, rows in enumerate(batches):
        results.stream_changed(stream_of(spark.createDataFrame(rows, fields), number, calls), str(tmp_path), "job_id", ["at"], "content")
        for _ in range(2):
            calls[number]()
    found = sorted((row.job_id or "", row.at, row.content or "") for row in results.read_changed(spark, str(tmp_path)).collect())
    assert [row for row in found if row[0] == "j"][:3] == [("j", 1, "A"), ("j", 3, "B"), ("j", 4, "A")]
    assert [row for row in found if row[0] == "k"] == [("k", 1, "A"), ("k", 3, "B")]


def test_results_are_judged_by_the_kept_states(spark, tmp_path):
    def event(i, job, status):
        return (f"{i}", job, START + timedelta(seconds=i), "E", status, "a", "", "{}")

    calls = {}
    job_events = spark.createDataFrame([event(1, "go", "RUNNING"), event(2, "stop", "RUNNING"), event(3, "stop", "CANCELLED")], JOB_FIELDS)
    node_rows = [("1", job, node, START, "E", status, "MAP", 0, 0, 0, "a", "", "{}") for job, node, status in [("go", "n1", "RUNNING"), ("go", "n2", "DONE"), ("stop", "n1", "RUNNING")]]
    node_events = spark.createDataFrame(node_rows, NODE_FIELDS)
    state.stream_current_state(stream_of(job_events, 0, calls), str(tmp_path / "jobs"))
    calls[0]()
    state.stream_current_state(stream_of(node_events, 0, calls), str(tmp_path / "nodes"), state.NODE_KEYS, state.NODE_VALUES)
    calls[0]()
    given = spark.createDataFrame([("go", "n1", "a"), ("go", "n2", "b"), ("go", "n9", "c"), ("stop", "n1", "d"), ("none", "n1", "e")], "job_id string, node_id string, content string")
    results.stream_discard_late_by_state(stream_of(given, 0, calls), str(tmp_path / "jobs"), str(tmp_path / "nodes"), str(tmp_path / "out"))
    calls[0]()
    assert {(row.content, row.discard_reason) for row in spark.read.parquet(str(tmp_path / "out")).collect()} == {
        ("a", None), ("b", "node_status_changed"), ("c", "node_missing"), ("d", "job_not_runnable"), ("e", "job_missing"),
    }


def test_node_state_equals_the_batch_read(spark, logs):
    out = str(logs / "node-state")
    source = stream(spark, logs / "nodes", NODE_FIELDS)
    run(state.stream_current_state(source, out, state.NODE_KEYS, state.NODE_VALUES), logs, "nodes")
    same(
        state.read_current_state(spark, out, state.NODE_KEYS, state.NODE_VALUES),
        nodes.node_current(spark.read.parquet(str(logs / "nodes"))),
    )


def test_recent_events_equal_the_batch_read(spark, logs):
    out = str(logs / "recent")
    writer = state.stream_recent_events(
        stream(spark, logs / "jobs", JOB_FIELDS), stream(spark, logs / "nodes", NODE_FIELDS), out, 50
    )
    run(writer, logs, "recent")
    expected = jobs.recent_events(spark.read.parquet(str(logs / "jobs")), spark.read.parquet(str(logs / "nodes")), 50)
    same(state.read_recent_events(spark, out), expected)


def test_stale_nodes_are_reported_once_their_time_has_passed(spark, tmp_path):
    def node(i, name, seconds, status):
        return (f"{i:03}", "j", name, START + timedelta(seconds=seconds), "E", status, "MAP", 0, i, 0, "a", "", "{}")

    batches = [
        [node(1, "slow", 0, "RUNNING"), node(2, "quick", 0, "RUNNING"), node(3, "waiting", 0, "QUEUED")],
        [node(4, "quick", 50, "DONE"), node(5, "waiting", 20, "RUNNING")],
        [node(6, "late", 90, "RUNNING"), node(7, "other", 135, "DONE")],
        [node(8, "other", 136, "DONE")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, NODE_FIELDS).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        spark.createDataFrame(rows, NODE_FIELDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "nodes"))
    out = str(tmp_path / "stale")
    limits = nodes.Timeouts(queue_seconds=130.0, call_seconds=0.0)
    run(stale.stream_stale_nodes(stream(spark, tmp_path / "nodes", NODE_FIELDS), out, "0 seconds", limits), tmp_path, "stale")
    rows = {row.node_id: row for row in stale.read_stale_nodes(spark, out).collect()}
    # Running nodes have max(130, 0 + 120) seconds: only "slow" is older than that at the last event.
    assert set(rows) == {"slow"}
    assert rows["slow"].stale_at == START + timedelta(seconds=130)


def stale_batches(spark, folder, batches, delay="0 seconds"):
    """Reports after each batch, by the function that a stream calls; every batch is replayed once."""
    calls = []
    writer = stale.stream_stale_nodes(SimpleNamespace(writeStream=SimpleNamespace(foreachBatch=lambda store: store)), folder, delay, nodes.Timeouts(queue_seconds=10.0))
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame([("j", name, START + timedelta(seconds=at), f"{at:03}", status) for name, at, status in rows], "job_id string, node_id string, event_time timestamp, event_id string, node_status string")
        for _ in range(2):
            writer(frame, number)
        calls.append(sorted((row.node_id, (row.stale_at - START).total_seconds()) for row in stale.read_stale_nodes(spark, folder).collect()))
    return calls


def test_watched_nodes_leave_when_they_are_told_or_done(spark, tmp_path):
    out = str(tmp_path / "stale")
    batches = [
        [("a", 0, "QUEUED"), ("b", 0, "QUEUED"), ("c", 1, "DONE")],
        [("b", 9, "DONE"), ("d", 11, "QUEUED")],
        # Late: "b" has left, "d" is watched; an event of "a" opens it anew.
        [("b", 3, "QUEUED"), ("d", 10, "DONE"), ("a", 12, "QUEUED")],
        [],
        [("e", 40, "DONE")],
    ]
    first = [("a", 10.0)]
    assert stale_batches(spark, out, batches) == [[], first, first, first, [("a", 10.0), ("a", 22.0), ("d", 21.0)]]
    left = spark.read.parquet(f"{out}/batch_id=4").where("part = 'watched'")
    assert [row.node_id for row in left.collect()] == ["e"]
    assert sorted(kept.names(spark, f"{out}/batch_id=1")) == ["_SUCCESS", "part=stale"]


def test_delay_of_stale_nodes(spark, tmp_path):
    batches = [[("a", 0, "QUEUED"), ("b", 12, "DONE")], [("a", 5, "DONE"), ("b", 30, "DONE")]]
    assert stale_batches(spark, str(tmp_path / "now"), batches) == [[("a", 10.0)]] * 2
    assert stale_batches(spark, str(tmp_path / "later"), batches, "5 seconds") == [[], []]


def test_duplicate_deliveries_are_dropped(spark, tmp_path):
    fields = "job_id string, node_id string, content_hash string, created_at timestamp"
    rows = [("j", f"n{i % 5}", f"h{i % 3}", START + timedelta(seconds=i)) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], fields).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    unique = results.stream_dedupe(stream(spark, tmp_path / "in", fields))
    run(unique.writeStream.format("parquet").outputMode("append").option("path", out), tmp_path, "dedupe")
    kept = spark.read.parquet(out)
    assert kept.count() == 15 == kept.select("job_id", "node_id", "content_hash").distinct().count()


def test_late_results_are_discarded(spark, tmp_path):
    def event(i, job, status):
        return (f"{i}", job, START + timedelta(seconds=i), "E", status, "a", "", "{}")

    job_events = spark.createDataFrame([event(1, "go", "RUNNING"), event(2, "stop", "RUNNING"), event(3, "stop", "CANCELLED")], JOB_FIELDS)
    node_events = spark.createDataFrame(
        [
            ("1", job, node, START, "E", status, "MAP", 0, 0, 0, "a", "", "{}")
            for job, node, status in [("go", "n1", "RUNNING"), ("go", "n2", "PAUSED"), ("stop", "n1", "RUNNING")]
        ],
        NODE_FIELDS,
    )
    fields = "job_id string, node_id string, content string"
    given = [("go", "n1", "a"), ("go", "n2", "b"), ("go", "n9", "c"), ("stop", "n1", "d"), ("none", "n1", "e")]
    spark.createDataFrame(given, fields).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    writer = results.stream_discard_late(stream(spark, tmp_path / "in", fields), lambda: job_events, lambda: node_events, out)
    run(writer, tmp_path, "late")
    assert {(row.content, row.discard_reason) for row in spark.read.parquet(out).collect()} == {
        ("a", None),
        ("b", "node_status_changed"),
        ("c", "node_missing"),
        ("d", "job_not_runnable"),
        ("e", "job_missing"),
    }


def test_ingest_of_arriving_files(spark, tmp_path):
    folder, root = tmp_path / "staged", str(tmp_path / "tables")
    folder.mkdir()
    (folder / "a one.log").write_text("".join(f"line {i} {'x' * 60}\n" for i in range(40)))
    (folder / "b.csv").write_text("time,log,pod\n" + "".join(f"t{i:03},row {i} {'y' * 40},p\n" for i in range(30)))
    (folder / "c.log").write_text("\n \n")
    run(ingest.stream_ingest(spark, str(folder), root, budget=256, max_files=2), tmp_path, "ingest")

    def check():
        segments = spark.read.parquet(f"{root}/input_segments")
        assert segments.agg(F.sum("rows_count")).first()[0] == 70
        assert segments.select("job_id", "segment_index").distinct().count() == segments.count()
        assert commits.read_table(spark, root, "input_segments").count() == segments.count()
        state_of = {row.last_event_type for row in jobs.job_current(spark.read.parquet(f"{root}/job_events")).collect()}
        assert state_of == {"INPUT_READY", "JOB_FAILED"}
        text = "\n".join(row.content for row in segments.filter("source_format = 'plain_text'").orderBy("segment_index").collect())
        assert text == "\n".join(f"line {i} {'x' * 60}" for i in range(40))

    check()
    tables = ("job_events", "input_segments", "artifacts", "input_rejects")
    before = {table: spark.read.parquet(f"{root}/{table}").count() for table in tables}
    # A replay of the same files adds nothing.
    ingest.ingest_batch(spark.read.format("binaryFile").load(str(folder)).select("path").withColumn(
        "job_id", F.concat(F.lit("job_"), F.substring(F.sha2("path", 256), 1, 32))), root, 256)
    check()
    assert before == {table: spark.read.parquet(f"{root}/{table}").count() for table in tables}


def test_an_ingest_that_stops_between_two_tables_is_not_seen_and_replays_whole(spark, tmp_path, monkeypatch):
    folder = tmp_path / "staged"
    folder.mkdir()
    (folder / "a.log").write_text("".join(f"line {i} {'x' * 60}\n" for i in range(40)))
    (folder / "b.json").write_text('[{"raw_line": "one"}, {}]')
    (folder / "c.log").write_text("\n")
    files = spark.read.format("binaryFile").load(str(folder)).select("path")
    files = files.withColumn("job_id", F.concat(F.lit("job_"), F.substring(F.sha2("path", 256), 1, 32)))
    tables = ("job_events", "input_segments", "artifacts", "input_rejects")

    def told(root):
        found = {}
        for table in tables:
            rows = commits.read_table(spark, root, table)
            shown = [name for name in rows.columns if name not in ("event_time", "created_at", "artifact_id")]
            found[table] = sorted(map(repr, rows.select(*shown).collect()))
        return found

    ingest.ingest_batch(files, str(tmp_path / "once"), 256)
    want = told(str(tmp_path / "once"))
    assert len(want["job_events"]) == 3 * 2 + 2 + 3
    put, finish = commits.put, commits.finish
    for stop_at in ("input_rejects", "input_segments", "artifacts", "job_events", "finish"):
        root = str(tmp_path / stop_at)

        def stopping(rows, where, table, *rest, stop_at=stop_at):
            put(rows, where, table, *rest)
            if table == stop_at:
                raise RuntimeError("stopped")

        def failing(*_):
            raise RuntimeError("stopped")

        monkeypatch.setattr(commits, "put", stopping)
        monkeypatch.setattr(commits, "finish", failing)
        with pytest.raises(RuntimeError):
            ingest.ingest_batch(files, root, 256)
        monkeypatch.setattr(commits, "put", put)
        monkeypatch.setattr(commits, "finish", finish)
        assert all(rows is None or not rows.count() for rows in (commits.read_table(spark, root, table) for table in tables))
        ingest.ingest_batch(files, root, 256)
        assert told(root) == want
    ingest.ingest_batch(files, root, 256)
    assert told(root) == want


def test_progress_counts_up(spark):
    rows = [("j", i, 3) for i in range(7)] + [("k", 0, 2)]
    found = ingest.progress(spark.createDataFrame(rows, "job_id string, segment_index long, rows_count long"), 3).orderBy("job_id", "number").collect()
    assert [tuple(row) for row in found] == [("j", 0, 3, 9, 3), ("j", 1, 6, 18, 6), ("j", 2, 7, 21, 7), ("k", 0, 1, 2, 1)]
