"""Readers for exported log files: plain text, CSV, Markdown tables, JSON arrays.

All give records of one shape: ``source_id`` (the file), ``block`` and ``line`` (the
order inside it), the record fields and ``reject_reason``. Even one huge file is read by
many tasks: plain text and Markdown by lines, CSV and JSON by splits that are read from
their true state (:mod:`logweir.sources.splits`).
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterator
from functools import reduce as fold

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.functions.records import normalize_rows, plain_records
from logweir.functions.text import is_blank, let, strip
from logweir.session import cut
from logweir.sources.formats import FORMATS, UnsupportedFormat, detect_format
from logweir.sources.splits import WHOLE, CsvLines, JsonItems, Splits, lines_of, may_split, read_splits, read_whole, whole_files

HEAD_BYTES = 65_536
DELIMITERS = ",;\t"
# A header row is at most HEAD_BYTES long, in practice far shorter.
BROADCAST_FILES = 2_000
PLACE = ["source_id", "block", "line"]


class UnreadableInput(ValueError):
    """A file does not have the shape of its format."""


def _per_file(table: DataFrame, files_count: int) -> DataFrame:
    """A one-row-per-file table for a join; broadcast if the files are few enough."""
    return F.broadcast(table) if files_count <= BROADCAST_FILES else table


def read_plain_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One record per non-blank line; leading blanks are kept."""
    lines = lines_of(spark, paths).filter(~is_blank(F.col("value")))
    return plain_records(lines, F.col("value"), PLACE)


# ---------------------------------------------------------------------- CSV
def _csv_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dialect of each file, told from its first lines, and its header row."""
    for source, _, _, lines in Splits(batches):
        kept, size = [], 0
        for _, line in lines:
            kept.append(line)
            size += len(line) + 1
            if size >= HEAD_BYTES:
                break
        try:
            dialect = csv.Sniffer().sniff("\n".join(kept)[:HEAD_BYTES], delimiters=DELIMITERS)
        except csv.Error:
            dialect = csv.excel
        form = CsvLines(dialect.delimiter, dialect.quotechar or '"', bool(dialect.skipinitialspace))

        def all_lines(kept=kept, lines=lines) -> Iterator[str]:
            for line in kept:
                yield line + "\n"
            for _, line in lines:
                yield line + "\n"

        header = next((row for row in form.rows(all_lines()) if any(cell.strip() for cell in row)), [])
        yield pa.RecordBatch.from_arrays(
            [pa.array([source]), pa.array([form.delimiter]), pa.array([form.quote]), pa.array([form.skip_space]), pa.array([header], pa.list_(pa.string()))],
            names=["source_id", "delimiter", "quote", "skip_space", "header"],
        )


HEAD = "source_id string, delimiter string, quote string, skip_space boolean, header array<string>"


def csv_layouts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Dialect and header of each file, by its first split, in which the header ends."""
    return lines_of(spark, paths).where("block = 0").mapInArrow(_csv_heads, HEAD)


def listing(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, source_id, length`` of each file; contents are not read."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("_metadata.file_path").alias("source_id"), "length")


def read_csv_logs(spark: SparkSession, paths: str | list[str], raw_line_column: str | None = None) -> DataFrame:
    """Records of CSV or TSV files with a header row, quoted cells over several lines.

    Files of one dialect are read together, and a large file by many tasks. The driver
    holds the file names, as it does for any file scan, never their rows. A file without a
    header line, empty or blank, gives one rejected row.
    """
    listed = listing(spark, paths)
    layouts = cut(csv_layouts(spark, paths))
    known = {row["source_id"]: row for row in listed.collect()}
    dialects: dict[tuple, list] = {}
    blank = []
    for row in layouts.select("source_id", "delimiter", "quote", "skip_space", F.size("header").alias("width")).collect():
        if row["width"] == 0:
            blank.append(row["source_id"])
            continue
        dialects.setdefault((row["delimiter"], row["quote"], row["skip_space"]), []).append(known[row["source_id"]])
    # A scan leaves out files of no bytes; the listing has them.
    blank += sorted(name for name in map(_like_metadata, listed.inputFiles()) if name not in set(map(_like_metadata, known)))
    if not dialects and not blank:
        raise UnreadableInput("nothing to read: no such CSV file")
    parts = [_read_dialect(spark, CsvLines(*dialect), files, layouts, raw_line_column) for dialect, files in dialects.items()]
    if blank:
        parts.append(_without_header(spark, blank))
    return fold(DataFrame.unionByName, parts)


def _like_metadata(name: str) -> str:
    """A listed file name as ``_metadata.file_path`` writes it."""
    return re.sub(r"^file:/+", "file:/", name)


def _without_header(spark: SparkSession, files: list[str]) -> DataFrame:
    """One rejected row for each of the files."""
    rows = spark.createDataFrame([(name,) for name in files], "source_id string").select(
        "source_id", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("line"),
        F.create_map().cast("map<string,string>").alias("_row"),
    )
    return normalize_rows(rows, "_row", None, PLACE).withColumn("reject_reason", F.lit("no header line"))


def _read_dialect(spark: SparkSession, form: CsvLines, files: list, layouts: DataFrame, raw_line_column: str | None) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cells_of(records: pd.Series) -> pd.Series:
        return records.map(lambda record: next(form.rows(line + "\n" for line in record.split("\n")), []))

    lines = lines_of(spark, [row["path"] for row in files])
    cells = read_splits(lines, form, may_split(spark, max(row["length"] for row in files)), cells_of)
    cells = cells.drop("error").withColumnRenamed("cells", "_cells")
    filled = cells.filter(F.exists("_cells", lambda cell: ~is_blank(F.coalesce(cell, F.lit("")))))
    headers = _per_file(layouts.select("source_id", "header"), len(files))
    rows = filled.join(headers, "source_id").withColumn("_row", _row_map(F.col("header"), F.col("_cells")))
    return normalize_rows(rows, "_row", raw_line_column, PLACE)


def _row_map(header, cells):
    """Header to cell, missing cells empty; surplus cells joined under ``_extra``."""
    width = F.size(header)
    named = F.zip_with(
        header,
        F.slice(cells, F.lit(1), width),
        lambda key, cell: F.struct(key.alias("key"), F.coalesce(cell, F.lit("")).alias("value")),
    )
    surplus = F.filter(F.slice(cells, width + 1, F.greatest(F.size(cells) - width, F.lit(0))), lambda cell: cell.isNotNull())
    extra = F.array(F.struct(F.lit("_extra").alias("key"), F.array_join(surplus, " ").alias("value")))
    return F.map_from_entries(F.when(F.size(surplus) > 0, F.concat(named, extra)).otherwise(named))


# ----------------------------------------------------------------- Markdown
def table_cells(line):
    """Cells of one Markdown table row; a backslash keeps a pipe inside its cell."""
    inner = F.regexp_replace(F.regexp_replace(line, r"^\|", ""), r"\|$", "")
    # A line feed ends the last cell, so that a lone backslash there stays one.
    raw = F.regexp_extract_all(F.concat(inner, F.lit("\n|")), F.lit(r"((?:[^|\\]|\\[^\n]|\\(?=\n))*+)\|"), F.lit(1))
    plain = lambda cell: F.when(cell.contains("\\"), F.regexp_replace(cell, r"(\\[^|])|\\(\|)", "$1$2")).otherwise(cell)
    return F.transform(raw, lambda cell: strip(plain(cell)))


def read_markdown_table(spark: SparkSession, paths: str | list[str], raw_line_column: str | None = None) -> DataFrame:
    """Records of files with one Markdown table each.

    The header is the first table line of its file: a one-row-per-file aggregate
    joined back, so a file needs no task of its own.
    """
    read = lines_of(spark, paths)
    lines = read.withColumn("value", strip(F.col("value"))).filter(F.col("value").startswith("|"))
    place = F.struct("block", "line")
    headers = (
        lines.groupBy("source_id")
        .agg(F.min_by("value", place).alias("_header"), F.min(place).alias("_first"), F.count("*").alias("_rows"))
        .select("source_id", table_cells(F.col("_header")).alias("_names"), "_first", "_rows")
    )
    short = F.col("_rows") < 2
    width = F.size("_names")

    def fitted(cells: Column) -> Column:
        """Cells cut to the header, null for a separator or an empty row."""
        count = F.size(cells)
        folded = F.when(
            count > width,
            F.concat(
                F.slice(cells, F.lit(1), width - 1),
                F.array(F.array_join(F.slice(cells, width, count - width + 1), "|")),
            ),
        ).otherwise(F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - count, F.lit(0)))))
        separator = F.forall(cells, lambda cell: F.regexp_replace(cell, "^:+|:+$", "").rlike("^-+$"))
        filled = F.exists(cells, lambda cell: cell != "")
        return F.when(short | (~separator & filled), folded)

    lined = lines.join(_per_file(headers, len(read.inputFiles())), "source_id").filter(short | (place > F.col("_first")))
    # A generator, so that the filter doesn't split the lines once more.
    cells = F.explode_outer(F.transform(F.array(table_cells(F.col("value"))), fitted))
    split = lined.select("*", cells.alias("_cells")).filter(F.col("_cells").isNotNull())
    rows = split.withColumn("_row", F.map_from_arrays("_names", "_cells"))
    records = normalize_rows(rows, "_row", raw_line_column, [*PLACE, "_rows"])
    error = F.when(F.col("_rows") < 2, "table without a data row")
    return records.withColumn("reject_reason", F.coalesce(error, "reject_reason")).drop("_rows")


# --------------------------------------------------------------------- JSON
def read_json_array(spark: SparkSession, paths: str | list[str], raw_line_column: str | None = None) -> DataFrame:
    """Records of the first array of each file; objects are normalised, scalars are raw lines.

    The text is cut at its commas, so that a file of one line is read by many tasks as well; a file
    that is too small to be split is one row. A file with an item that cannot be read, or without a
    closed array, gives one rejected row and nothing else.
    """
    listed = listing(spark, paths)
    lengths = {row["source_id"]: row["length"] for row in listed.select("source_id", "length").collect()}
    small = [length for length in lengths.values() if not may_split(spark, length)]
    size = F.col("_metadata.file_size")
    found = []
    if small:
        found.append(read_whole(whole_files(spark, paths, size <= max(small)), JsonItems()))
    if len(small) < len(lengths):
        whole = lambda text: F.when(~is_blank(text), F.array(text))
        lines = lines_of(spark, paths, separator=",", only=size > max(small, default=0))
        found.append(read_splits(lines, JsonItems(), True, whole).withColumn("cells", F.col("cells")[0]))
    if not found:
        found.append(spark.createDataFrame([], WHOLE))
    read = fold(DataFrame.unionByName, found)
    # A variant knows the type of each item but sorts the keys; the text keeps their order.
    items = read.withColumnRenamed("cells", "_text").withColumn("_item", F.try_parse_json("_text"))
    items = items.withColumn("_kind", F.substring_index(F.schema_of_variant("_item"), "<", 1))
    items = items.withColumn("_values", F.when(F.col("_kind") == "OBJECT", F.try_variant_get("_item", "$", "map<string,variant>")))
    cells = F.map_from_entries(
        F.transform(
            F.json_object_keys("_text"),
            lambda key: F.struct(key.alias("key"), let(F.try_element_at(F.col("_values"), key), variant_text).alias("value")),
        )
    )
    unread = F.when(F.col("_item").isNull(), "the JSON array cannot be read")
    # Parsed once: failed files and records are both taken from the items.
    items = cut(
        items.select(
            *PLACE,
            F.coalesce("error", unread).alias("_error"),
            "_kind",
            F.when(F.col("_kind") == "OBJECT", cells).alias("_row"),
            F.when(F.col("_kind") != "OBJECT", F.coalesce(variant_text(F.col("_item")), F.lit(""))).alias("_plain"),
        )
    )
    failed = items.where(F.col("_error").isNotNull()).groupBy("source_id").agg(F.min("_error").alias("_error"))
    empty = sorted(set(map(_like_metadata, listed.inputFiles())) - set(map(_like_metadata, lengths)))
    if empty:
        # A scan leaves out files of no bytes; the listing has them.
        failed = failed.unionByName(spark.createDataFrame([(name, JsonItems().trouble(JsonItems.start)) for name in empty], failed.schema))
    good = items.join(failed.select("source_id"), "source_id", "left_anti")
    objects = good.filter(F.col("_kind") == "OBJECT")
    records = normalize_rows(objects, "_row", raw_line_column, PLACE)
    plain = plain_records(good.filter(F.col("_kind") != "OBJECT"), F.col("_plain"), PLACE)
    broken = failed.select(
        "source_id",
        F.lit(0).cast("long").alias("block"),
        F.lit(0).cast("long").alias("line"),
        *[F.lit("").alias(name) for name in records.columns if name not in (*PLACE, "attrs", "reject_reason")],
        F.create_map().cast("map<string,string>").alias("attrs"),
        F.col("_error").alias("reject_reason"),
    )
    return records.unionByName(plain).unionByName(broken)


def variant_text(value):
    """A JSON value as cell text: booleans as True and False, nested values as JSON."""
    truth = F.when(F.try_variant_get(value, "$", "boolean"), "True").otherwise("False")
    return let(
        F.substring_index(F.schema_of_variant(value), "<", 1),
        lambda kind: F.when(kind == "BOOLEAN", truth)
        .when(kind.isin("OBJECT", "ARRAY"), F.to_json(value))
        .otherwise(F.try_variant_get(value, "$", "string")),
    )


READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": read_csv_logs,
    "markdown": read_markdown_table,
    "json": read_json_array,
    "plain_text": lambda spark, paths, raw_line_column=None: read_plain_text(spark, paths),
}


def read_logs(
    spark: SparkSession, paths: str | list[str], source_format: str = "auto", raw_line_column: str | None = None
) -> DataFrame:
    """Records of files of any supported format; ``auto`` goes by the file names."""
    if source_format != "auto":
        if source_format.lower().strip() not in FORMATS:
            raise UnsupportedFormat(f"unsupported source_format: {source_format}")
        return READERS[source_format.lower().strip()](spark, paths, raw_line_column=raw_line_column)
    listing = spark.read.format("binaryFile").load(paths).select("path")
    by_format: dict[str, list[str]] = {}
    for row in listing.withColumn("kind", detect_format(F.col("path"), F.lit(""))).collect():
        by_format.setdefault(row["kind"], []).append(row["path"])
    parts = [READERS[kind](spark, names, raw_line_column=raw_line_column) for kind, names in by_format.items()]
    if not parts:
        raise UnreadableInput("nothing to read under this path")
    return fold(DataFrame.unionByName, parts)
