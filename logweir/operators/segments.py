"""Input segments: log records packed under a token budget, and reads over them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.functions.ids import content_hash
from logweir.functions.records import rendered
from logweir.functions.text import (
    CHARS_PER_TOKEN,
    MIN_TARGET_TOKENS,
    SPLIT_CHARS_PER_TOKEN,
    estimate_tokens,
    split_long_units,
    text_units,
)
from logweir.operators.latest import latest
from logweir.operators.packing import PART, Labeller, Limits, label_run, prepare
from logweir.session import spread

DEFAULT_CHUNK_TOKENS = 6000

PIECE_FIELDS = "segment_index long, part int, rows_count long, content string, first_timestamp string, last_timestamp string"


def _assemble(labeller: Labeller, edges: bool):
    """Join the rows of each segment inside a partition.

    Only the segment a partition starts in and the one it ends in can go on in a
    neighbour; these edge pieces and the whole segments are produced apart.
    """
    key = labeller.key

    def pieces(keys, labels, texts, times, offsets, part) -> pa.RecordBatch:
        starts, ends = offsets[:-1], offsets[1:]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), texts)
        filled = np.flatnonzero(np.asarray(pc.not_equal(times, "")))
        has_first = np.searchsorted(filled, starts, side="left")
        has_last = np.searchsorted(filled, ends, side="left") - 1
        known = has_last >= has_first
        padded = np.append(filled, 0)

        def pick(positions: np.ndarray) -> pa.Array:
            return times.take(pa.array(padded[np.where(known, positions, len(filled))], mask=~known)).fill_null("")

        return pa.RecordBatch.from_arrays(
            [
                keys.take(pa.array(starts)),
                pa.array(labels[starts]),
                pa.array(np.full(len(starts), part), pa.int32()),
                pa.array(ends - starts),
                pc.binary_join(lists, "\n"),
                pick(has_first),
                pick(has_last),
            ],
            names=[key, "segment_index", "part", "rows_count", "content", "first_timestamp", "last_timestamp"],
        )

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None
        part, head_is_edge = None, False
        for batch, labels, _ in labeller.batches(batches):
            columns = [batch.column(key), batch.column("rendered"), batch.column("timestamp").fill_null("")]
            if part is None:
                part = batch.column(PART)[0].as_py()
                entry = labeller.entry(batch)
                head_is_edge = entry is not None and labels[0] == entry.group
            if pending is not None:
                columns = [pa.concat_arrays(pair) for pair in zip(pending[:3], columns)]
                labels = np.concatenate([pending[3], labels])
            changes = labels[1:] != labels[:-1]
            same_key = pc.equal(columns[0].slice(1), columns[0].slice(0, len(labels) - 1)).fill_null(False)
            changes |= ~np.asarray(same_key)
            offsets = np.concatenate(([0], np.flatnonzero(changes) + 1))
            closed = offsets
            if len(closed) > 1:
                if head_is_edge:
                    if edges:
                        yield pieces(columns[0], labels, columns[1], columns[2], closed[:2], part)
                    closed, head_is_edge = closed[1:], False
                if len(closed) > 1 and not edges:
                    yield pieces(columns[0], labels, columns[1], columns[2], closed, part)
            last = offsets[-1]
            pending = [column.slice(last) for column in columns] + [labels[last:]]
        if pending is not None and edges:
            end = np.array([0, len(pending[3])])
            yield pieces(pending[0], pending[3], pending[1], pending[2], end, part)

    return assemble


def segment_rows(
    records: DataFrame,
    key: str,
    order: Sequence[str | Column],
    budget: int = DEFAULT_CHUNK_TOKENS,
    source_type: str = "upload",
    source_format: str = "plain_text",
    partitions: int | None = None,
) -> DataFrame:
    """Pack log records into segments of at most ``budget`` estimated tokens per key.

    The text is range-shuffled once. Whole segments are joined where they lie; only
    the pieces at partition edges are shuffled again.
    """
    limits = Limits(max(MIN_TARGET_TOKENS, budget))
    order_names = [name for name in order if isinstance(name, str)]
    slim = rendered(records).select(key, *order_names, "timestamp", "rendered", "tokens")
    packed = prepare(slim, key, order, F.col("tokens"), limits, partitions, keep=["timestamp", "rendered"])
    rows = packed.rows.select(PART, key, "_weight", "timestamp", "rendered")
    schema = T.StructType([slim.schema[key], *T.StructType.fromDDL(PIECE_FIELDS).fields])

    whole = rows.mapInArrow(_assemble(packed.labeller, edges=False), schema).drop("part")
    edge = rows.mapInArrow(_assemble(packed.labeller, edges=True), schema)
    parts = F.sort_array(
        F.collect_list(F.struct("part", "content", "first_timestamp", "last_timestamp"))
    )

    def filled(field: str) -> Column:
        return F.filter(F.col("_parts")[field], lambda value: value != "")

    merged = (
        edge.groupBy(key, "segment_index")
        .agg(F.sum("rows_count").alias("rows_count"), parts.alias("_parts"))
        .select(
            key,
            "segment_index",
            "rows_count",
            F.array_join(F.col("_parts.content"), "\n").alias("content"),
            F.coalesce(F.get(filled("first_timestamp"), 0), F.lit("")).alias("first_timestamp"),
            F.coalesce(F.try_element_at(filled("last_timestamp"), F.lit(-1)), F.lit("")).alias("last_timestamp"),
        )
    )
    return with_segment_facts(whole.unionByName(merged), source_type, source_format)


def with_segment_facts(segments: DataFrame, source_type: str, source_format: str) -> DataFrame:
    """Hash, length and metadata of assembled segments."""
    times = F.struct("first_timestamp", "last_timestamp")
    return segments.select(
        *[name for name in segments.columns if name not in ("content", "rows_count")],
        F.lit(source_type).alias("source_type"),
        F.lit(source_format).alias("source_format"),
        content_hash(F.col("content")).alias("content_hash"),
        "content",
        "rows_count",
        F.length("content").cast("long").alias("chars"),
        F.to_json(times).alias("metadata"),
    )


def _join_units(key: str, budget: int):
    """Greedy join of the units of each text; units and weights come from Spark."""

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, owner = batch.column("_units"), []
            offsets, index = [0], []
            limits = Limits(budget)
            weights = batch.column("_tokens")
            bounds = np.asarray(units.offsets) - units.offsets[0].as_py()
            flat = weights.flatten().to_numpy(zero_copy_only=False)
            for row in range(batch.num_rows):
                start, end = bounds[row], bounds[row + 1]
                if start == end:
                    continue
                labels, _ = label_run(flat[start:end], None, limits)
                cuts = np.flatnonzero(labels[1:] != labels[:-1]) + 1 + start
                offsets.extend([*cuts, end])
                owner.extend([row] * (len(cuts) + 1))
                index.extend(range(len(cuts) + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), units.flatten())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(pa.array(owner, pa.int64())),
                    pa.array(index, pa.int64()),
                    pc.binary_join(lists, "\n\n"),
                ],
                names=[key, "chunk_index", "content"],
            )

    return join


def build_chunks(df: DataFrame, key: str, text: str, budget: int = DEFAULT_CHUNK_TOKENS) -> DataFrame:
    """Chunks of each text: units, length splits, then a greedy join under the budget.

    One row per chunk: key, ``chunk_index`` from 0, ``content``. A text is one row, so
    all work on it stays in that row: no shuffle at any scale.
    """
    limit = max(MIN_TARGET_TOKENS, budget)
    units = spread(df.select(key, text)).select(
        key,
        split_long_units(text_units(F.col(text)), int(limit * SPLIT_CHARS_PER_TOKEN)).alias("_units"),
    )
    weighed = units.withColumn("_tokens", F.transform("_units", estimate_tokens))
    schema = T.StructType(
        [
            df.schema[key],
            T.StructField("chunk_index", T.LongType()),
            T.StructField("content", T.StringType()),
        ]
    )
    return weighed.mapInArrow(_join_units(key, limit), schema)


SEGMENT_KEY = ["job_id", "segment_index"]


def latest_segments(
    segments: DataFrame, include_content: bool = True, columns: Sequence[str] | None = None
) -> DataFrame:
    """Newest version of each segment. Columns that are not asked for are never read."""
    names = columns if columns is not None else [name for name in segments.columns if name not in SEGMENT_KEY]
    if not include_content:
        names = [name for name in names if name != "content"]
    return latest(segments, SEGMENT_KEY, ["created_at", "content_hash"], columns=names)


def clone_segments(segments: DataFrame, reruns: DataFrame) -> DataFrame:
    """The latest segments of rerun jobs under their new job ids, with their origin noted.

    ``reruns`` has ``job_id`` and ``new_job_id``.
    """
    rows = latest_segments(segments).join(reruns.select("job_id", "new_job_id"), "job_id")
    known = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    origin = F.create_map(
        F.lit("rerun_source_job_id"), F.col("job_id"),
        F.lit("rerun_source_segment_index"), F.col("segment_index").cast("string"),
    )
    return (
        rows.withColumn("metadata", F.to_json(F.map_concat(known, origin)))
        .withColumn("source_type", F.when(F.col("source_type") == "", "rerun").otherwise(F.col("source_type")))
        .withColumn("job_id", F.col("new_job_id"))
        .drop("new_job_id")
    )


def input_stats(segments: DataFrame) -> DataFrame:
    """Segments, rows, characters and estimated tokens per job."""

    def clipped(name: str) -> Column:
        return F.greatest(F.coalesce(F.col(name).cast("long"), F.lit(0)), F.lit(0).cast("long"))

    totals = segments.groupBy("job_id").agg(
        F.count("*").alias("segments_count"),
        F.sum(clipped("rows_count")).alias("rows_count"),
        F.sum(clipped("chars")).alias("chars"),
    )
    estimate = F.ceil(F.col("chars") / F.lit(CHARS_PER_TOKEN))
    return totals.withColumn("estimated_tokens", F.when(F.col("chars") > 0, estimate).otherwise(F.lit(0).cast("long")))


def count_segments(segments: DataFrame) -> DataFrame:
    """Distinct segment indexes per job."""
    return segments.groupBy("job_id").agg(F.count_distinct("segment_index").alias("segments_count"))


def manifest(segments: DataFrame, kind: str = "text") -> DataFrame:
    """INPUT artifact per job that sums up its segments."""
    totals = segments.groupBy("job_id").agg(
        F.count("*").alias("segments_count"),
        F.sum(F.col("rows_count").cast("long")).alias("rows_count"),
        F.sum(F.col("chars").cast("long")).alias("chars"),
    )
    described = F.struct("chars", "rows_count", "segments_count")
    content = F.format_string(
        f"{kind} input manifest: chars=%d, rows=%d, segments=%d", "chars", "rows_count", "segments_count"
    )
    return totals.select(
        "job_id",
        F.lit("").alias("node_id"),
        F.lit("INPUT").alias("artifact_type"),
        F.lit("INPUT").alias("stage"),
        F.lit(0).alias("level"),
        content.alias("content"),
        content_hash(content).alias("content_hash"),
        F.to_json(F.struct(described.alias("manifest"))).alias("metadata"),
    )
