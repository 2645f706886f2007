"""Guards on segments that are about to be stored."""

from __future__ import annotations

from pyspark.sql import DataFrame


def resume_ingest(new_segments: DataFrame, existing: DataFrame) -> DataFrame:
    """Segments of a replayed ingest that are not stored yet."""
    return new_segments.join(existing.select("job_id", "segment_index"), ["job_id", "segment_index"], "left_anti")
