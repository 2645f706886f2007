"""The summary value: deterministic summariser, JSON form, reduce-input block."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.pretty import pretty_json
from logweir.functions.text import LINE_BREAK, collapse_spaces, estimate_tokens, is_blank, let, strip

SUMMARY_TYPE = (
    "struct<ok:boolean,summary:string,key_points:array<string>,warnings:array<string>,source_count:int>"
)
# Fixed values of the deterministic summariser.
SUMMARY_CHARS = 420
KEY_POINTS = 5
# What is looked at first; the rest of a text only if this is not enough.
HEAD_CHARS = 640
HEAD_LINES = 12

_CANONICAL = (
    r"^OBJECT<key_points: ARRAY<(STRING|VOID)>, ok: BOOLEAN, source_count: BIGINT, "
    r"summary: STRING, warnings: ARRAY<(STRING|VOID)>>$"
)


def dry_summary(stage: Column, text: Column) -> Column:
    """Stage label and the head of the text with its white space collapsed."""
    cut = lambda flat: F.concat(
        F.lit("["),
        stage,
        F.lit("] "),
        F.when(F.length(flat) > SUMMARY_CHARS, F.concat(F.rtrim(F.substring(flat, 1, SUMMARY_CHARS)), F.lit("..."))).otherwise(flat),
    )
    # The head is enough if more than the summary is left of it.
    enough = lambda head: F.when((F.length(head) > SUMMARY_CHARS) | (F.length(text) <= HEAD_CHARS), head).otherwise(collapse_spaces(text))
    return let(let(collapse_spaces(F.substring(text, 1, HEAD_CHARS)), enough), cut)


def dry_key_points(text: Column) -> Column:
    """The first non-blank lines, white space collapsed."""

    def points(lines: Column) -> Column:
        return F.slice(F.filter(lines, lambda line: ~is_blank(line)), 1, KEY_POINTS)

    def found(parts: Column) -> Column:
        # The last part is the rest of the text if there are more lines.
        return F.when(F.size(parts) <= HEAD_LINES, points(parts)).otherwise(
            let(points(F.slice(parts, 1, HEAD_LINES)), lambda first: F.when(F.size(first) == KEY_POINTS, first).otherwise(points(F.split(text, LINE_BREAK))))
        )

    return F.transform(let(F.split(text, LINE_BREAK, HEAD_LINES + 1), found), collapse_spaces)


def dry_result(stage: Column, user: Column) -> Column:
    """Summary value of the deterministic summariser for one prompt."""
    blocks = (F.length(user) - F.length(F.replace(user, F.lit("\n\n"), F.lit("\n")))) + 1
    return F.struct(
        F.lit(True).alias("ok"),
        dry_summary(stage, user).alias("summary"),
        dry_key_points(user).alias("key_points"),
        F.array().cast("array<string>").alias("warnings"),
        F.greatest(F.lit(1), blocks).cast("int").alias("source_count"),
    )


def json_text(text: Column) -> Column:
    """A JSON string literal; control characters in lower-case hexadecimal."""

    def lowered(literal: Column) -> Column:
        fixed = literal
        for code in ("000E", "000F", "001A", "001B"):
            fixed = F.regexp_replace(fixed, r"(?<!\\)((?:\\\\)*)\\u" + code, r"$1\\u" + code.lower())
        return F.when(literal.contains("\\u00"), fixed).otherwise(literal)

    # to_json writes an object; its fixed head {"t": and its tail } are cut off.
    whole = F.to_json(F.struct(text.alias("t")))
    return let(let(whole, lambda object_text: F.substring(object_text, F.lit(6), F.length(object_text) - F.lit(6))), lowered)


def summary_json(result: Column | Mapping[str, Column]) -> Column:
    """The summary value as JSON text, indented by two spaces."""

    def items(values: Column) -> Column:
        lines = F.array_join(F.transform(values, lambda value: F.concat(F.lit("    "), json_text(value))), ",\n")
        return F.when(F.size(values) == 0, "[]").otherwise(F.concat(F.lit("[\n"), lines, F.lit("\n  ]")))

    return F.concat(
        F.lit('{\n  "ok": '),
        result["ok"].cast("string"),
        F.lit(',\n  "summary": '),
        json_text(result["summary"]),
        F.lit(',\n  "key_points": '),
        items(result["key_points"]),
        F.lit(',\n  "warnings": '),
        items(result["warnings"]),
        F.lit(',\n  "source_count": '),
        result["source_count"].cast("string"),
        F.lit("\n}"),
    )


def summary_body(result: Column | Mapping[str, Column]) -> Column:
    """Summary and key points of a value as they enter the next reduce prompt."""
    points = F.array_join(F.transform(result["key_points"], lambda point: F.concat(F.lit("- "), point)), "\n")
    return F.concat(result["summary"], F.lit("\n"), points)


def json_shape(text: Column) -> Column:
    """Type of a JSON object or array; empty text for anything else.

    Only texts that start like one are parsed: failing to parse is the slow case.
    """
    shape = F.schema_of_variant(F.try_parse_json(text))
    nested = F.when(shape.startswith("OBJECT") | shape.startswith("ARRAY"), shape)
    return F.when(text.startswith("{") | text.startswith("["), F.coalesce(nested, F.lit(""))).otherwise("")


def is_summary_json(text: Column) -> Column:
    """Whether a text is exactly a summary value in JSON."""
    return F.coalesce(json_shape(strip(text)).rlike(_CANONICAL), F.lit(False))


def with_body(df: DataFrame, content: str = "content", body: str = "body") -> DataFrame:
    """Add the body of stored content: a summary value, other JSON indented, or the text as is.

    Only content that needs indenting visits Python.
    """
    raw, shape = F.col("_raw"), F.col("_shape")
    staged = df.withColumn("_raw", strip(F.col(content))).withColumn("_shape", json_shape(raw))
    is_summary = shape.rlike(_CANONICAL)
    indented = staged.withColumn("_pretty", pretty_json(F.when((shape != "") & ~is_summary, raw)))
    text = F.when(is_summary, summary_body(F.from_json(raw, SUMMARY_TYPE))).otherwise(
        F.concat(F.coalesce("_pretty", raw), F.lit("\n"))
    )
    return indented.withColumn(body, text).drop("_raw", "_shape", "_pretty")


def summary_block(index: Column, body: Column) -> Column:
    """One numbered block of a reduce prompt."""
    return strip(F.concat(F.lit("Summary "), index.cast("string"), F.lit(":\n"), body))


def reduce_tokens(body: Column) -> Column:
    """Token estimate of content as the first block of a reduce prompt."""
    return estimate_tokens(summary_block(F.lit(1), body))
