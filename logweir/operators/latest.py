"""Latest-row reads over append-only tables.

One struct is compared once per row and travels whole, instead of one comparison
per column; partial aggregation leaves one row per key and task before the shuffle,
so a hot key costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(
    df: DataFrame,
    keys: Sequence[str],
    version: Sequence[str | Column],
    columns: Sequence[str] | None = None,
    **extra: Column,
) -> DataFrame:
    """The newest row per key by ``version``; ``extra`` are further aggregates."""
    carried = [name for name in (columns or df.columns) if name not in keys and name not in extra]
    row = F.max_by(F.struct(*carried), F.struct(*version)) if carried else F.lit(None)
    grouped = df.groupBy(*keys).agg(
        row.alias("_row"), *[column.alias(name) for name, column in extra.items()]
    )
    return grouped.select(*keys, *[f"_row.{name}" for name in carried], *extra)


def newest_first(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(limit)
