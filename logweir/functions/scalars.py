"""Scalar expressions on names, URLs, errors and loosely typed JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.functions.text import let

# Outcome words of an external workflow run.
FAILED_OUTCOMES = ["failed", "error", "cancelled", "stopped", "timeout"]


def safe_filename(name: Column) -> Column:
    cleaned = F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")
    cleaned = F.regexp_replace(cleaned, r"^[._]+|[._]+$", "")
    return F.when(F.coalesce(cleaned, F.lit("")) == "", F.lit("upload")).otherwise(cleaned)


def mask_url_credentials(url: Column) -> Column:
    """Replace ``user:password`` in the authority of a URL by ``***:***``.

    As with a URL that is taken apart and put together again, the scheme and the
    host come out in lower case; a URL without credentials is left alone.
    """
    authority = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)@([^/?#]*)(.*)$"
    scheme = F.lower(F.regexp_extract(url, authority, 1))
    user_info = F.regexp_extract(url, authority, 2)
    host = F.lower(F.regexp_extract(url, authority, 3))
    rest = F.regexp_extract(url, authority, 4)
    has_credentials = ~user_info.isin("", ":")
    masked = F.concat(scheme, F.lit("//***:***@"), F.regexp_replace(host, ":0*$", ""), rest)
    return F.when(has_credentials, masked).otherwise(url)


def classify_error(message: Column) -> Column:
    """Error class by the first matching rule on the lower-cased message."""

    def rules(text: Column) -> Column:
        def has(*words: str) -> Column:
            hit = F.lit(False)
            for word in words:
                hit = hit | text.contains(word)
            return hit

        # The words and their order.
        return (
            F.when(has("context") & has("length", "too long", "maximum"), "context_too_long")
            .when(has("rate limit", "429"), "rate_limit")
            .when(has("llm pool"), "llm_pool_busy")
            .when(has("timeout", "timed out"), "timeout")
            .when(has("503", "502", "500", "connection"), "provider_unavailable")
            .when(has("json", "validation", "schema"), "schema_or_json")
            .otherwise("unknown")
        )

    return let(F.lower(message), rules)


def run_outcome(status: Column) -> Column:
    word = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(word.isin(FAILED_OUTCOMES), "FAILED").otherwise("DONE")


def non_negative(value: Column) -> Column:
    return F.greatest(F.coalesce(value.try_cast("long"), F.lit(0)), F.lit(0).cast("long"))


def json_value(json_text: Column, path: str) -> Column:
    """Value at ``path`` with its JSON type; null if absent or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(json_text), path, "variant")


NUMBER_KIND = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def json_whole_number(json_text: Column, path: str) -> Column:
    """Whole number at ``path``: 7, 7.0 and "7" give 7; booleans and the rest null."""

    def as_number(value: Column) -> Column:
        kind = F.schema_of_variant(value)
        text = F.try_variant_get(value, "$", "string")
        number = F.try_variant_get(value, "$", "double")
        return F.when((kind == "STRING") & text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("long")).when(
            kind.rlike(NUMBER_KIND) & (number == F.floor(number)), number.cast("long")
        )

    return let(json_value(json_text, path), as_number)


def json_positive_number(json_text: Column, path: str) -> Column:
    """A number at ``path`` cut to its whole part, if it is above zero."""

    def as_number(value: Column) -> Column:
        number = F.try_variant_get(value, "$", "double")
        return F.when(F.schema_of_variant(value).rlike(NUMBER_KIND) & (number > 0), number.cast("long"))

    return let(json_value(json_text, path), as_number)


def sorted_json(entries: Column) -> Column:
    """JSON object text of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))
