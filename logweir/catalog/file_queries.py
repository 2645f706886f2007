"""Readers over files that Spark writes from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.catalog import duck
from logweir.catalog.fixtures import Tables
from logweir.catalog.registry import query
from logweir.functions.records import accepted
from logweir.functions.scalars import sorted_json
from logweir.session import ensure_checkpoint_dir
from logweir.sources import files

ROWS_PER_FILE = 2_000
RECORD = ["raw_line", "timestamp", "end_time", "namespace", "container_name", "pod_name"]


def work_folder(t: Tables) -> str:
    """A new folder beside the checkpoints, on storage all executors share."""
    return f"{ensure_checkpoint_dir(t.spark)}/work-{uuid.uuid4().hex}"


def write_lines(lines: DataFrame, folder: str, part: str, order: str | None = None) -> None:
    """Text files of ``value``, at least one per value of ``part``, in order inside a file."""
    # By a hash of the part: a union of inputs placed by the part itself would not be placed anew.
    placed = lines.repartition(F.xxhash64(part))
    if order is not None:
        placed = placed.sortWithinPartitions(part, order)
    placed.select(part, "value").write.partitionBy(part).text(folder)


EXPECTED = """ SELECT raw_line, timestamp, end_time, namespace, container_name, pod_name,
  '{"k":"' || k || '"' || CASE WHEN shard <> '' THEN ',"shard":"' || shard || '"' ELSE '' END || '}' AS attrs FROM log_records"""


def shown(records: DataFrame) -> DataFrame:
    return accepted(records).select(*RECORD, sorted_json(F.col("attrs")).alias("attrs"))


@query(
    "s1_read_plain_text",
    "",
    f"""WITH split AS (SELECT unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) AS raw_line FROM documents)
    SELECT raw_line, count(*) AS lines FROM split WHERE {duck.strip('raw_line')} <> '' GROUP BY raw_line""",
)
def s1(t: Tables):
    folder = work_folder(t)
    t.read("documents").select("text").write.text(folder)
    return files.read_plain_text(t.spark, folder).groupBy("raw_line").agg(F.count("*").alias("lines"))


@query("s2_read_csv_logs", "log_records", EXPECTED)
def s2(t: Tables):
    folder = work_folder(t)
    t.raw_rows.drop("job_id", "pos").write.option("header", True).option("escape", '"').csv(folder)
    return shown(files.read_csv_logs(t.spark, folder))


@query("s3_read_markdown_table", "log_records", EXPECTED)
def s3(t: Tables):
    folder = work_folder(t)
    rows = t.raw_rows.drop("job_id").withColumn("part", F.floor(F.col("pos") / ROWS_PER_FILE))
    names = [name for name in rows.columns if name not in ("pos", "part")]
    cells = [F.coalesce(F.col(name), F.lit("")) for name in names]
    body = rows.select("part", "pos", F.concat(F.lit("|"), F.concat_ws("|", *cells), F.lit("|")).alias("value"))
    parts = rows.select("part").distinct()
    head = parts.select("part", F.lit(-2).cast("long").alias("pos"), F.lit("|" + "|".join(names) + "|").alias("value"))
    rule = parts.select("part", F.lit(-1).cast("long").alias("pos"), F.lit("|" + "---|" * len(names)).alias("value"))
    write_lines(body.unionByName(head).unionByName(rule), folder, "part", "pos")
    return shown(files.read_markdown_table(t.spark, folder))


@query("s4_read_json_array", "log_records", EXPECTED)
def s4(t: Tables):
    folder = work_folder(t)
    rows = t.raw_rows.drop("job_id").withColumn("part", F.floor(F.col("pos") / ROWS_PER_FILE))
    names = [name for name in rows.columns if name not in ("pos", "part")]
    body = rows.select("part", "pos", F.concat(F.lit(", "), F.to_json(F.struct(*names))).alias("value"))
    parts = rows.select("part").distinct()
    head = parts.select("part", F.lit(-1).cast("long").alias("pos"), F.lit('{"SELECT [1]": ["head"').alias("value"))
    tail = parts.select("part", F.lit(2**62).cast("long").alias("pos"), F.lit("]}").alias("value"))
    write_lines(body.unionByName(head).unionByName(tail), folder, "part", "pos")
    return shown(files.read_json_array(t.spark, folder).filter("raw_line <> 'head'"))


STATE_COPY = """ SELECT 'job' AS kind, job_id, '' AS node_id, event_type, '{"k":"' || CAST(json_extract(payload, '$.k') AS VARCHAR) || '"}' AS payload, count(*) AS rows_written, count(*) AS ids FROM job_events GROUP BY ALL
  UNION ALL SELECT 'node', job_id, node_id, event_type, payload, count(*), count(*) FROM node_events GROUP BY ALL"""


@query("k1_append_events", "job_events node_events", STATE_COPY)
def k1(t: Tables):
    from logweir.sources.sinks import append_events

    folder = work_folder(t)
    events = t.job_events.withColumn("payload", F.from_json("payload", "map<string,string>")).drop("event_id")
    for _ in range(2):
        # The second time is a replay.
        append_events(events, folder, "job_events", commit="first")
        append_events(t.node_events, folder, "node_events", commit="first")
    jobs = t.spark.read.parquet(f"{folder}/job_events").select(F.lit("job").alias("kind"), "job_id", F.lit("").alias("node_id"), "event_type", "payload", "event_id")
    nodes = t.spark.read.parquet(f"{folder}/node_events").select(F.lit("node").alias("kind"), "job_id", "node_id", "event_type", "payload", "event_id")
    keys = ["kind", "job_id", "node_id", "event_type", "payload"]
    return jobs.unionByName(nodes).groupBy(*keys).agg(F.count("*").alias("rows_written"), F.count_distinct("event_id").alias("ids"))


@query(
    "k3_append_segments",
    "segments",
    " SELECT job_id, segment_index, content_hash, count(*) AS copies FROM segments GROUP BY ALL",
)
def k3(t: Tables):
    from logweir.sources.sinks import append_segments

    folder = work_folder(t)
    for _ in range(2):
        append_segments(t.segments.drop("created_at"), folder, F.lit("2024-01-01").cast("timestamp"), commit="first")
    written = t.spark.read.parquet(f"{folder}/input_segments")
    return written.groupBy("job_id", "segment_index", "content_hash").agg(F.count("*").alias("copies"))


@query("k5_append_snapshots", "runs", " SELECT run_id, snapshot_id, status FROM runs")
def k5(t: Tables):
    from logweir.sources.sinks import append_snapshots

    folder = work_folder(t)
    append_snapshots(t.runs.filter("status = 'DONE'"), folder, "run")
    for _ in range(2):
        append_snapshots(t.runs.filter("status <> 'DONE'"), folder, "run", commit="second")
    return t.spark.read.parquet(f"{folder}/monitoring_runs").select("run_id", "snapshot_id", "status")
