"""Content hashes and deterministic node ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def hash_or_empty(text: Column) -> Column:
    """SHA-256 of a non-empty text; an empty text stays empty."""
    return F.when(F.length(text) > 0, F.sha2(text, 256)).otherwise(F.lit(""))


def short_hash(text: Column, length: int = 16) -> Column:
    return F.substring(content_hash(text), 1, length)


def node_id(job_id: Column, node_type: str, level: Column, index: Column, input_hash: Column) -> Column:
    """``<type>_<24 hex>`` derived from job, type, level, index and input hash."""
    raw = F.concat_ws(
        "|", job_id, F.lit(node_type), level.cast("string"), index.cast("string"), input_hash
    )
    return F.concat(F.lit(node_type.lower() + "_"), short_hash(raw, 24))
