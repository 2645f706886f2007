"""Row normalisation: loose export columns to the one log record shape.

Two entry points share the rules. ``normalize_columns`` works on a DataFrame with
fixed columns and resolves names once, at plan time. ``normalize_rows`` works on a
map column (one map per row, keys may differ per row) as the file readers give it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.text import estimate_tokens, strip

# Candidate column names, first match wins, case-insensitive.
RAW_LINE_NAMES = ["raw_line", "log", "message", "line", "raw", "text"]
FIELD_NAMES = {
    "timestamp": ["timestamp", "time", "start_time", "event_time"],
    "end_time": ["end_time", "finish_time", "finished_at"],
    "namespace": ["namespace", "kubernetes_namespace_name", "k8s_namespace"],
    "container_name": ["container_name", "kubernetes_container_name", "container"],
    "pod_name": ["pod_name", "kubernetes_pod_name", "pod"],
}

MISSING_COLUMN = "no column holds the log line"
EMPTY_ROW = "no log text in this row"


class MissingRawLineColumn(ValueError):
    """The requested raw-line column is not among the columns."""


def clean_map(row: Column) -> Column:
    """Keys stripped, values stripped texts, null as empty text."""
    cleaned = F.transform_values(row, lambda _, value: strip(F.coalesce(value, F.lit(""))))
    return F.transform_keys(cleaned, lambda key, _: strip(key))


def pick_name(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The column matching the first candidate that is present at all."""
    by_lower = {name.strip().lower(): name for name in columns}
    for candidate in candidates:
        if candidate.lower() in by_lower:
            return by_lower[candidate.lower()]
    return None


def pick_key(names: Column, candidates: Sequence[str]) -> Column:
    """Map-row form of :func:`pick_name`; ``names`` maps lower-cased key to key."""
    return F.coalesce(*[F.element_at(names, candidate.lower()) for candidate in candidates])


def _non_empty_cells(cells: Column) -> Column:
    return F.array_join(F.filter(cells, lambda cell: cell != ""), " ")


def normalize_columns(
    df: DataFrame, raw_line_column: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Log records from a DataFrame of fixed columns; ``keep`` columns pass through.

    A row without any text gets ``reject_reason`` instead of a raw line, so that a
    strict caller can count rejects and a lenient one can set them aside.
    """
    names = [name for name in df.columns if name not in set(keep)]
    cell = {name: strip(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))) for name in names}
    if raw_line_column:
        raw_name = pick_name(names, [raw_line_column])
        if raw_name is None:
            raise MissingRawLineColumn(f"{MISSING_COLUMN}: {raw_line_column}")
    else:
        raw_name = pick_name(names, RAW_LINE_NAMES)
        if raw_name is None and len(names) == 1:
            raw_name = names[0]
    picked = {field: pick_name(names, candidates) for field, candidates in FIELD_NAMES.items()}
    used = {raw_name, *picked.values()}

    joined = _non_empty_cells(F.array(*cell.values()))
    raw_line = joined
    if raw_name is not None:
        raw_line = F.when(cell[raw_name] != "", cell[raw_name]).otherwise(joined)
    extras = [item for name in names if name not in used and name.strip() for item in (F.lit(name.strip()), cell[name])]
    attrs = F.create_map(*extras) if extras else F.create_map().cast("map<string,string>")
    record = df.select(
        *keep,
        raw_line.alias("raw_line"),
        *[(cell[name] if name else F.lit("")).alias(field) for field, name in picked.items()],
        F.map_filter(attrs, lambda _, value: value != "").alias("attrs"),
    )
    return record.withColumn("reject_reason", F.when(F.col("raw_line") == "", F.lit(EMPTY_ROW)))


def settled(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The same rows, for filters over costly columns.

    Spark moves a filter below a projection and works out there what it asks for once more, here
    the whole row for each key that is looked up. It doesn't move it below a generator.
    """
    made = [name for name in df.columns if name not in keep]
    return df.select(*keep, F.inline_outer(F.array(F.struct(*made))))


def normalize_rows(
    df: DataFrame, row: str, raw_line_column: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Log records from a map column; rules as in :func:`normalize_columns`."""
    staged = (
        df.withColumn("_cells", clean_map(F.col(row)))
        .withColumn(
            "_names",
            F.map_from_entries(
                F.transform(
                    F.map_keys("_cells"), lambda key: F.struct(F.lower(key).alias("k"), key.alias("v"))
                )
            ),
        )
    )
    names = F.col("_names")
    if raw_line_column:
        raw_key = pick_key(names, [raw_line_column])
        missing = raw_key.isNull()
    else:
        only = F.when(F.size("_cells") == 1, F.map_keys("_cells")[0])
        raw_key = F.coalesce(pick_key(names, RAW_LINE_NAMES), only)
        missing = F.lit(False)
    keys = {field: pick_key(names, candidates) for field, candidates in FIELD_NAMES.items()}
    staged = staged.select(
        *keep,
        "_cells",
        missing.alias("_missing"),
        raw_key.alias("_raw_key"),
        *[key.alias(f"_{field}_key") for field, key in keys.items()],
    )
    used = F.array("_raw_key", *[f"_{field}_key" for field in keys], F.lit(""))

    def cell(key: str) -> Column:
        return F.coalesce(F.element_at("_cells", F.col(key)), F.lit(""))

    raw_line = F.when(cell("_raw_key") != "", cell("_raw_key")).otherwise(
        _non_empty_cells(F.map_values("_cells"))
    )
    record = staged.select(
        *keep,
        "_missing",
        raw_line.alias("raw_line"),
        *[cell(f"_{field}_key").alias(field) for field in keys],
        F.map_filter(
            "_cells",
            lambda key, value: (value != "") & ~F.exists(used, lambda name: F.coalesce(name == key, F.lit(False))),
        ).alias("attrs"),
    )
    reason = F.when(F.col("_missing"), F.lit(MISSING_COLUMN)).when(
        F.col("raw_line") == "", F.lit(EMPTY_ROW)
    )
    return settled(record.withColumn("reject_reason", reason).drop("_missing"), keep)


def plain_records(df: DataFrame, raw_line: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Records that carry a raw line and nothing else."""
    return df.select(
        *keep,
        raw_line.alias("raw_line"),
        *[F.lit("").alias(field) for field in FIELD_NAMES],
        F.create_map().cast("map<string,string>").alias("attrs"),
        F.lit(None).cast("string").alias("reject_reason"),
    )


def accepted(records: DataFrame) -> DataFrame:
    return records.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(records: DataFrame) -> DataFrame:
    return records.filter(F.col("reject_reason").isNotNull())


def render() -> Column:
    """One line per record: time range, source, sorted attributes, raw line."""

    def labelled(label: str, name: str) -> Column:
        return F.when(F.col(name) != "", F.concat(F.lit(label), F.col(name)))

    end = F.when(F.col("end_time") != "", F.col("end_time")).otherwise(F.col("timestamp"))
    has_time = (F.col("timestamp") != "") | (F.col("end_time") != "")
    times = F.when(has_time, F.concat(F.lit("["), F.col("timestamp"), F.lit(" -> "), end, F.lit("]")))
    filled = F.filter(F.map_entries("attrs"), lambda entry: entry["value"] != "")
    attrs = F.transform(
        F.array_sort(filled), lambda entry: F.concat(entry["key"], F.lit("="), entry["value"])
    )
    return F.concat_ws(
        "  ",
        times,
        labelled("namespace=", "namespace"),
        labelled("container=", "container_name"),
        labelled("pod=", "pod_name"),
        attrs,
        F.when(F.col("raw_line") != "", F.col("raw_line")),
    )


def rendered(records: DataFrame) -> DataFrame:
    """Records with their rendered line and its token estimate."""
    return records.withColumn("rendered", render()).withColumn(
        "tokens", estimate_tokens(F.col("rendered"))
    )
