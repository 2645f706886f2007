"""Registered queries: a Spark side and, where SQL can say it, a checking side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from logweir.catalog.fixtures import Tables, with_tables
from logweir.session import configure


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(configure(spark), folder))


REGISTRY: dict[str, Query] = {}


def query(name: str, tables: str = "", sql: str | None = None, recursive: bool = False):
    """Register a query; ``tables`` are the derived tables its SQL starts from."""
    text = sql
    if sql is not None and tables:
        joiner = ", " if sql.lstrip().startswith(",") else "\n"
        body = sql.lstrip()[1:] if joiner == ", " else sql
        text = with_tables(*tables.split(), recursive=recursive) + joiner + body

    def register(build: Callable[[Tables], DataFrame]):
        REGISTRY[name] = Query(build, text)
        return build

    return register
