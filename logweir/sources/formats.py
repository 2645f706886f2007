"""Input format of a file by request, name and content type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.functions.text import let, strip

# Format names and the file suffixes that imply them.
FORMATS = ["csv", "markdown", "json", "plain_text"]
SUFFIXES = {".json": "json", ".md": "markdown", ".markdown": "markdown", ".csv": "csv", ".tsv": "csv"}
TEXT_SUFFIXES = [".txt", ".text", ".log"]


class UnsupportedFormat(ValueError):
    """The requested format is not one of ``FORMATS``."""


def file_suffix(filename: Column) -> Column:
    """Lower-cased last suffix of the base name; a leading dot does not start one."""
    base = F.regexp_extract(F.coalesce(filename, F.lit("")), r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(base, r"[^.](\.[^.]+)$", 1))


def detect_format(filename: Column, content_type: Column, requested: Column | None = None) -> Column:
    """Format name; null where an unknown format was asked for."""
    asked = F.lower(strip(F.coalesce(requested, F.lit("auto")))) if requested is not None else F.lit("auto")
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    by_suffix = F.create_map(*[F.lit(item) for pair in SUFFIXES.items() for item in pair])

    def guess(suffix: Column) -> Column:
        return (
            F.when(F.try_element_at(by_suffix, suffix).isNotNull(), F.try_element_at(by_suffix, suffix))
            .when(kind.contains("json"), "json")
            .when(kind.contains("markdown"), "markdown")
            .when(suffix.isin(TEXT_SUFFIXES) | kind.startswith("text/plain"), "plain_text")
            .otherwise("csv")
        )

    explicit = ~asked.isin("", "auto")
    return F.when(explicit & asked.isin(FORMATS), asked).when(~explicit, let(file_suffix(filename), guess))
