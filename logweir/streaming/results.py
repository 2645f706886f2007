"""Guards on streams of stage results, and the feed of changed snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from logweir.operators.artifacts import judge_by_state, judge_results
from logweir.operators.ordered import with_previous
from logweir.streaming import kept, state


def stream_dedupe(results: DataFrame, delay: str = "1 hour", time: str = "created_at") -> DataFrame:
    """Drop further deliveries of the same content for a node within ``delay``."""
    timed = results.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.dropDuplicatesWithinWatermark(["job_id", "node_id", "content_hash"])


def stream_discard_late(
    results: DataFrame,
    read_job_events: Callable[[], DataFrame],
    read_node_events: Callable[[], DataFrame],
    folder: str,
    expected_status: str = "RUNNING",
) -> DataStreamWriter:
    """A writer that judges each batch of results against the state at that moment.

    The event logs are read anew for every batch. Judged rows go to ``folder``, with
    ``discard_reason`` null where the result is good.
    """

    def judge(batch: DataFrame, batch_id: int) -> None:
        judged = judge_results(batch, read_job_events(), read_node_events(), expected_status)
        judged.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return results.writeStream.foreachBatch(judge)


def stream_discard_late_by_state(
    results: DataFrame, job_folder: str, node_folder: str, folder: str, expected_status: str = "RUNNING"
) -> DataStreamWriter:
    """:func:`stream_discard_late` against the states that :func:`state.stream_current_state` keeps.

    A batch is joined with the kept rows of its own jobs and nodes; the logs are not read.
    """

    def judge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jobs = state.read_current_state(spark, job_folder, only=batch)
        nodes = state.read_current_state(spark, node_folder, state.NODE_KEYS, state.NODE_VALUES, only=batch)
        kept.write(judge_by_state(batch, jobs, nodes, expected_status), folder, batch_id)

    return results.writeStream.foreachBatch(judge)


def stream_changed(snapshots: DataFrame, folder: str, key: str, order: Sequence[str], content: str) -> DataStreamWriter:
    """A writer that keeps the snapshots whose content differs from the one before of the same key.

    One hash a key is kept from batch to batch. The feed goes forward: inside a batch
    snapshots are taken by ``order``, and one that is not after the last of its key from earlier
    batches is left out. Changed rows, with ``snapshot_hash`` and ``previous_hash``, go to
    ``folder/changed``.
    """
    last = f"{folder}/last"

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place = F.struct(*order)
        rows = batch.withColumn("snapshot_hash", F.sha2(F.col(content), 256))
        before = kept.before(spark, last, batch_id)
        if before is None:
            rows = rows.withColumn("_known", F.lit(None).cast("string"))
        else:
            known = before.select(F.col(key).alias("_key"), F.col("snapshot_hash").alias("_known"), F.struct(*order).alias("_place"))
            joined = rows.join(known, F.col(key).eqNullSafe(F.col("_key")), "left")
            rows = joined.where(F.col("_place").isNull() | (place > F.col("_place"))).drop("_key", "_place")
        paired = with_previous(rows, key, list(order), {"previous_hash": F.col("snapshot_hash")})
        paired = paired.withColumn("previous_hash", F.coalesce("previous_hash", "_known")).drop("_known")
        changed = paired.where(F.col("previous_hash").isNull() | (F.col("previous_hash") != F.col("snapshot_hash")))
        kept.write(changed, f"{folder}/changed", batch_id)
        narrow = rows.select(key, *order, "snapshot_hash")
        newest = narrow if before is None else narrow.unionByName(before)
        row = F.max_by(F.struct(*order, "snapshot_hash"), place).alias("row")
        kept.write(newest.groupBy(key).agg(row).select(key, "row.*"), last, batch_id)
        kept.forget(spark, last, batch_id)

    return snapshots.writeStream.foreachBatch(store)


def read_changed(spark, folder: str) -> DataFrame:
    """All changed snapshots so far."""
    return spark.read.option("basePath", f"{folder}/changed").parquet(f"{folder}/changed").drop(kept.BATCH)
