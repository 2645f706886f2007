"""Log records from read queries over registered views or other catalogs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.records import normalize_columns

MAX_PREVIEW = 500


class UnreadableQuery(ValueError):
    """A statement that does more than read, or rows that are no log."""


def read_only(spark: SparkSession, statement: str) -> DataFrame:
    """The result of a statement that Spark's parser takes for a plain query.

    Commands (writes, DDL, settings) have a plan of their own kind and are refused before they run.
    """
    text = statement.strip()
    while text.endswith(";"):
        text = text[:-1].rstrip()
    if not re.match(r"(?i)(?:select|with|from|values|table)\b|\(", text):
        raise UnreadableQuery(f"a query is wanted here, not: {text[:40]!r}")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    if plan.getClass().getSimpleName().startswith(("Insert", "Create", "Replace")) or "Command" in plan.getClass().getSimpleName():
        raise UnreadableQuery(f"this statement changes something: {text[:40]!r}")
    return spark.sql(text)


def read_query(
    spark: SparkSession,
    query: str,
    raw_line_column: str | None = None,
    keep: tuple[str, ...] = (),
    strict: bool = True,
) -> DataFrame:
    """Records of a query result. ``strict`` fails on an empty result, before any job exists."""
    records = normalize_columns(read_only(spark, query), raw_line_column, keep)
    if strict and records.filter(F.col("reject_reason").isNull()).isEmpty():
        raise UnreadableQuery("no row of the result has a log line")
    return records


def preview(spark: SparkSession, query: str, limit: int = 100) -> DataFrame:
    """First rows of a read query; the limit is kept between 1 and 500."""
    return read_only(spark, query).limit(max(1, min(int(limit), MAX_PREVIEW)))
