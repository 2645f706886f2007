"""Text expressions: white space, token estimate, text units, length splits.

Spark's ``trim`` knows only the space and Java's ``\\s`` only ASCII; log texts
need the full Unicode notion of white space, so one character class is shared by
all expressions here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Visible ASCII is told first, by one range.
LINE_BREAK = r"(?![ -~])(?:\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029])"

# Fixed values of the token estimate and of the chunk splitter.
CHARS_PER_TOKEN = 2.2
SPLIT_CHARS_PER_TOKEN = 2.0
MIN_TARGET_TOKENS = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapse_spaces(text: Column) -> Column:
    # Most characters are visible ASCII: one range tells so, before those of the class are gone through.
    return F.trim(F.regexp_replace(text, f"[[^!-~]&&[{SPACE_CLASS}]]+", " "))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE_CLASS}]")


def estimate_tokens(text: Column) -> Column:
    """``max(1, ceil(code points / 2.2))`` in double arithmetic."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)))


def non_blank_parts(text: Column, separator: str) -> Column:
    parts = F.transform(F.split(text, separator), strip)
    return F.filter(parts, lambda part: part != "")


def text_units(text: Column) -> Column:
    """Paragraphs if there are several, else the lines, else the text itself."""

    def units(clean: Column) -> Column:
        def pick(paragraphs: Column) -> Column:
            return F.when(F.size(paragraphs) > 1, paragraphs).otherwise(
                non_blank_parts(clean, LINE_BREAK)
            )

        return F.when(clean == "", F.array().cast("array<string>")).otherwise(
            let(non_blank_parts(clean, "\n\n"), pick)
        )

    return let(strip(F.regexp_replace(text, "\r\n?", "\n")), units)


def split_long(unit: Column, max_chars: int) -> Column:
    """Cut one unit every ``max_chars`` characters; strip pieces, drop empty ones."""
    pieces = F.transform(F.regexp_extract_all(unit, F.lit(f"(?s).{{1,{max_chars}}}"), F.lit(0)), strip)
    return F.when(F.length(unit) <= max_chars, F.array(unit)).otherwise(F.filter(pieces, lambda piece: piece != ""))


def split_long_units(units: Column, max_chars: int) -> Column:
    return F.flatten(F.transform(units, lambda unit: split_long(unit, max_chars)))

