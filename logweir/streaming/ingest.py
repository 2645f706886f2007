"""Staged files become segments as they arrive.

All tables of a batch are committed together: nothing of a batch that stopped half-way is
seen, and a replay writes the same folders again.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from logweir.functions.ids import short_hash
from logweir.functions.records import accepted
from logweir.operators.segments import DEFAULT_CHUNK_TOKENS, manifest, segment_rows
from logweir.session import cut
from logweir.sources import commits, files, sinks
from logweir.sources.commits import read_table
from logweir.sources.formats import detect_format

# The steps an ingest reports and the job status each one means.
STATUS_OF = {
    "JOB_CREATED": "INGESTING",
    "INPUT_INGEST_STARTED": "INGESTING",
    "INPUT_INGEST_PROGRESS": "INGESTING",
    "INPUT_READY": "INPUT_READY",
    "JOB_FAILED": "FAILED",
}
# Fixed value: segments after which an ingest reports its progress.
PROGRESS_SEGMENTS = 500


def stream_files(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Stream of the files that arrive in a folder: names only, no content."""
    listing = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
        .select("path", "length", "modificationTime")
    )
    return listing.withColumn("job_id", F.concat(F.lit("job_"), short_hash(F.col("path"), 32)))


def _job_events(jobs: DataFrame, event_type: str, message, payload, number=None) -> DataFrame:
    """Events of one step; ``number`` tells repeated steps of a job apart."""
    number = F.lit(0) if number is None else number
    # Steps of one commit have the same moment but for their order.
    step = list(STATUS_OF).index(event_type) * 1_000_000 + F.least(number, F.lit(999_999))
    parts = ["job_id", F.lit(event_type)] if event_type != "INPUT_INGEST_PROGRESS" else ["job_id", F.lit(event_type), number.cast("string")]
    return jobs.select(
        # The same step of the same file has the same id.
        short_hash(F.concat_ws("|", *parts), 32).alias("event_id"),
        "job_id",
        F.timestamp_micros(F.unix_micros(F.current_timestamp()) + step).alias("event_time"),
        F.lit(event_type).alias("event_type"),
        F.lit(STATUS_OF[event_type]).alias("job_status"),
        F.lit("stream_ingest").alias("actor"),
        message.alias("message"),
        payload.alias("payload"),
    )


def progress(segments: DataFrame, every: int = PROGRESS_SEGMENTS) -> DataFrame:
    """``job_id, number, segments_seen, rows_seen, inserted_segments`` after each ``every`` segments of a job."""
    number = F.floor(F.col("segment_index") / every).cast("long").alias("number")
    blocks = segments.groupBy("job_id", number).agg(F.count("*").alias("segments"), F.sum("rows_count").alias("rows"))
    # One row for so many segments: a job's window is small.
    so_far = Window.partitionBy("job_id").orderBy("number")
    return blocks.select(
        "job_id", "number", F.sum("segments").over(so_far).alias("segments_seen"), F.sum("rows").over(so_far).alias("rows_seen"),
        F.sum("segments").over(so_far).alias("inserted_segments"),
    )


def ingested_jobs(spark: SparkSession, root: str) -> DataFrame | None:
    """Jobs whose ingest is over."""
    events = read_table(spark, root, "job_events")
    return None if events is None else events.where(F.col("event_type").isin("INPUT_READY", "JOB_FAILED")).select("job_id").distinct()


def ingest_batch(batch: DataFrame, root: str, budget: int = DEFAULT_CHUNK_TOKENS) -> None:
    """Read, normalise, pack and commit the files of one batch, one job per file; files that are done are left out."""
    spark = batch.sparkSession
    listed = batch.select("path", "job_id").withColumn("source_format", detect_format(F.col("path"), F.lit("")))
    done = ingested_jobs(spark, root)
    listed = cut(listed if done is None else listed.join(done, "job_id", "left_anti"))
    found = {}
    for row in listed.select("path", "source_format").collect():
        found.setdefault(row["source_format"], []).append(row["path"])
    if not found:
        return
    names = F.array_join(F.sort_array(F.collect_list("job_id")), "|")
    commit = commits.TOGETHER + listed.agg(short_hash(names, 32)).first()[0]

    rejects, parts, inputs = [], [], []
    for kind, paths in found.items():
        # Readers name a file by its URI; the job id comes from the listed path.
        path = F.regexp_replace(F.url_decode(F.replace(F.col("source_id"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
        rows = files.READERS[kind](spark, paths).withColumn("job_id", F.concat(F.lit("job_"), short_hash(path, 32)))
        reason = rows.filter(F.col("reject_reason").isNotNull()).groupBy("job_id", "reject_reason")
        rejects.append(reason.agg(F.count("*").alias("rows_count"), F.min(F.struct("block", "line")).alias("first_place")))
        segments = segment_rows(accepted(rows), "job_id", ["block", "line"], budget, "upload", kind)
        parts.append(segments.drop("first_timestamp", "last_timestamp"))
        inputs.append(kind)
    united = lambda frames: fold(DataFrame.unionByName, frames)
    commits.put(united(rejects), root, "input_rejects", ["job_id"], commit)
    sinks.append_segments(united(parts), root, F.current_timestamp(), commit)

    segments = spark.read.parquet(f"{root}/input_segments/{commits.COMMIT}={commit}")
    ready = united([manifest(segments.where(F.col("source_format") == kind), f"{kind} upload") for kind in inputs])
    sinks.append_artifacts(ready, root, F.current_timestamp(), commit=commit)
    ready = ready.select("job_id", "content", "metadata")
    source = F.to_json(F.struct(F.struct(F.col("path").alias("filename"), F.col("source_format").alias("format")).alias("source")))
    seen = F.to_json(F.struct("segments_seen", "rows_seen", "inserted_segments"))
    none, failed = F.lit("{}"), listed.join(segments.select("job_id").distinct(), "job_id", "left_anti")
    events = [
        _job_events(listed, "JOB_CREATED", F.col("path"), source),
        _job_events(listed, "INPUT_INGEST_STARTED", F.lit(""), none),
        _job_events(progress(segments), "INPUT_INGEST_PROGRESS", F.lit(""), seen, F.col("number")),
        _job_events(ready, "INPUT_READY", F.col("content"), F.col("metadata")),
        _job_events(failed, "JOB_FAILED", F.lit("no log row could be read from this file"), none),
    ]
    sinks.append(united(events), root, "job_events", commit)
    commits.finish(spark, root, commit)


def stream_ingest(spark: SparkSession, folder: str, root: str, budget: int = DEFAULT_CHUNK_TOKENS, max_files: int = 1000) -> DataStreamWriter:
    """A writer that ingests every file arriving in ``folder`` into the tables under ``root``."""

    def store(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, root, budget)

    return stream_files(spark, folder, max_files).writeStream.foreachBatch(store)
