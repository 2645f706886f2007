"""Reading one huge file with many tasks where quotes and nesting reach across lines.

Spark splits a text file at any separator, and a line belongs to the split it starts in.
What a split means depends on the state before it: whether it starts inside a quoted cell
or a string, and how deep inside brackets. So:

1. each split of a file with more than one tells its effect for every possible state before
   it, a few numbers;
2. the effects of a file's splits are applied in order, which gives the true state before each;
3. each split is read from its true state. It returns its whole records, and the pieces of
   those that go on over its edges;
4. the pieces, two a split at most, are put together in order.

The driver holds one small state for each split of such files, as it holds the splits
themselves to plan the scan. Files of one split skip the first two steps.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOM = "\ufeff"
#: Records handed on at once.
BATCH = 2048
State = tuple[int, ...]
Lines = Iterator[tuple[int, str]]


def lines_of(spark: SparkSession, paths: str | list[str], separator: str | None = None, only: Column | None = None) -> DataFrame:
    """``source_id, block, line, single, value``: lines with their place; ``single`` if the file is one split.

    The byte order mark is dropped. ``only`` chooses files by their metadata.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    lines = reader.text(paths).where(F.lit(True) if only is None else only).select(
        F.col("_metadata.file_path").alias("source_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        (F.col("_metadata.file_block_length") == F.col("_metadata.file_size")).alias("single"),
        "value",
    )
    return lines.withColumn("value", F.regexp_replace("value", "^" + BOM, ""))


def whole_files(spark: SparkSession, paths: str | list[str], only: Column) -> DataFrame:
    """``source_id, value``: files of one row each, chosen by their metadata; the byte order mark is dropped."""
    files = spark.read.text(paths, wholetext=True).where(only)
    return files.select(F.col("_metadata.file_path").alias("source_id"), F.regexp_replace("value", "^" + BOM, "").alias("value"))


WHOLE = "source_id string, block long, line long, cells string, error string"


def read_whole(files: DataFrame, form: JsonItems) -> DataFrame:
    """``source_id, block, line, cells, error`` of the records of files that are one row each; cells are the record's text."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, text in zip(batch.column("source_id"), batch.column("value")):
                places, texts, error = form.whole(text.as_py())
                if error:
                    places, texts = [*places, 0], [*texts, None]
                count = len(places)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([source.as_py()] * count, pa.string()),
                        pa.array([0] * count, pa.int64()),
                        pa.array(places, pa.int64()),
                        pa.array(texts, pa.string()),
                        pa.array([None] * (count - bool(error)) + [error] * bool(error), pa.string()),
                    ],
                    names=["source_id", "block", "line", "cells", "error"],
                )

    return files.select("source_id", "value").mapInArrow(parse, WHOLE)


def may_split(spark: SparkSession, largest: int) -> bool:
    """Whether Spark may split a file of so many bytes."""
    conf = spark._jsparkSession.sessionState().conf()
    return largest > min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())


class Format(Protocol):
    """What the reading of splits needs to know of a format."""

    #: State at the start of a file, and what stands between two lines of a record.
    start: State
    joint: str

    def effect(self, lines: Iterable[str]) -> list[int]:
        """What a split does to every state before it."""

    def applied(self, effect: list[int], state: State) -> State:
        """The state after a split, from its effect and the state before it."""

    def goes_on(self, state: State) -> bool:
        """Whether a record is open in this state."""

    def trouble(self, state: State) -> str | None:
        """What is wrong with a file that ends in this state."""

    def read(self, lines: Lines, state: State, first: bool, single: bool) -> Iterator[Found]:
        """Whole records and open pieces of a split, the first or the only one of its file."""


@dataclass
class Found:
    """A record with its cells, or a piece of one (``place`` 0 before the first start of a record, 1 after the last)."""

    line: int
    cells: list[str] | None = None
    piece: str | None = None
    place: int = 1
    error: str | None = None


@dataclass
class Splits:
    """Runs of lines of one split in the rows of a task."""

    batches: Iterator[pa.RecordBatch]
    pending: list = field(default_factory=list)

    def __iter__(self) -> Iterator[tuple[str, int, bool, Lines]]:
        rows = self._rows()
        row = next(rows, None)
        while row is not None:
            source, block, single = row[:3]
            rest: list = []

            def own(first=row, source=source, block=block, rest=rest) -> Lines:
                current = first
                while current is not None and current[0] == source and current[1] == block:
                    yield current[3], current[4]
                    current = next(rows, None)
                rest.append(current)

            lines = own()
            yield source, block, single, lines
            for _ in lines:
                pass
            row = rest[0]

    def _rows(self) -> Iterator[tuple[str, int, bool, int, str]]:
        for batch in self.batches:
            columns = [batch.column(name).to_pylist() for name in ("source_id", "block", "single", "line", "value")]
            yield from zip(*columns)


def split_states(lines: DataFrame, form: Format) -> tuple[dict[tuple[str, int], State], dict[str, State]]:
    """The state before each split of the files with more than one, and after each such file."""

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source, block, _, own in Splits(batches):
            effect = form.effect(value for _, value in own)
            yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array([block]), pa.array([effect], pa.list_(pa.int64()))], names=["source_id", "block", "effect"])

    def in_order(rows: pa.Table) -> pa.Table:
        found, state = [], form.start
        for block, effect in sorted(zip(rows["block"].to_pylist(), rows["effect"].to_pylist())):
            found.append((block, list(state)))
            state = form.applied(effect, state)
        # The state after the last split.
        found.append((-1, list(state)))
        return pa.table(
            {
                "source_id": pa.array([rows["source_id"][0].as_py()] * len(found)),
                "block": pa.array([block for block, _ in found], pa.int64()),
                "state": pa.array([state for _, state in found], pa.list_(pa.int64())),
            }
        )

    told = lines.where(~F.col("single")).mapInArrow(effects, "source_id string, block long, effect array<long>")
    rows = told.groupBy("source_id").applyInArrow(in_order, "source_id string, block long, state array<long>").collect()
    before = {(row["source_id"], row["block"]): tuple(row["state"]) for row in rows if row["block"] >= 0}
    return before, {row["source_id"]: tuple(row["state"]) for row in rows if row["block"] < 0}


READ = "source_id string, block long, line long, cells array<string>, piece string, place int, error string"


def read_splits(lines: DataFrame, form: Format, split: bool, cells: Callable) -> DataFrame:
    """``source_id, block, line, cells, error`` of all records.

    ``cells`` makes the cells of a record of a column with its text, for those put together from pieces.
    """
    before, finally_ = split_states(lines, form) if split else ({}, {})
    states = lines.sparkSession.sparkContext.broadcast(before)

    def read(pieces: bool):
        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple[str, int, Found]] = []
            for source, block, single, own in Splits(batches):
                for found in form.read(own, states.value.get((source, block), form.start), block == 0, single):
                    if (found.piece is not None) == pieces:
                        rows.append((source, block, found))
                    if len(rows) >= BATCH:
                        yield table(rows)
                        rows = []
            if rows:
                yield table(rows)

        return parse

    def table(rows: list[tuple[str, int, Found]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([source for source, _, _ in rows]),
                pa.array([block for _, block, _ in rows], pa.int64()),
                pa.array([found.line for *_, found in rows], pa.int64()),
                pa.array([found.cells for *_, found in rows], pa.list_(pa.string())),
                pa.array([found.piece for *_, found in rows], pa.string()),
                pa.array([found.place for *_, found in rows], pa.int32()),
                pa.array([found.error for *_, found in rows], pa.string()),
            ],
            names=["source_id", "block", "line", "cells", "piece", "place", "error"],
        )

    out = ["source_id", "block", "line", "cells", "error"]
    whole = lines.mapInArrow(read(False), READ).select(out)
    wrong = [(source, 0, 0, None, form.trouble(state)) for source, state in finally_.items() if form.trouble(state)]
    if wrong:
        whole = whole.unionByName(lines.sparkSession.createDataFrame(wrong, whole.schema))
    if not any(map(form.goes_on, [*before.values(), *finally_.values()])):
        return whole
    # A record's first piece is the last of its split; those of the next splits follow.
    ordered = Window.partitionBy("source_id").orderBy("block", "place")
    pieces = lines.where(~F.col("single")).mapInArrow(read(True), READ).withColumn("record", F.sum("place").over(ordered))
    parts = F.sort_array(F.collect_list(F.struct("block", "place", "line", "piece")))
    joined = pieces.groupBy("source_id", "record").agg(parts.alias("parts")).select(
        "source_id",
        F.col("parts")[0]["block"].alias("block"),
        F.col("parts")[0]["line"].alias("line"),
        cells(F.array_join("parts.piece", form.joint)).alias("cells"),
        F.lit(None).cast("string").alias("error"),
    )
    return whole.unionByName(joined.where(F.col("cells").isNotNull()))


# ---------------------------------------------------------------------- CSV
@dataclass(frozen=True)
class CsvLines:
    """CSV of one dialect. The state is whether a line starts inside a quoted cell."""

    delimiter: str
    quote: str
    skip_space: bool
    start: State = (0,)
    joint: str = "\n"

    def patterns(self) -> tuple[re.Pattern, re.Pattern]:
        """Lines that leave no cell open, begun outside and inside a quoted cell.

        A cell is quoted if it begins with a quote; one quote within that isn't doubled ends
        the quoted part, and what follows up to the delimiter is taken as it is.
        """
        quote, delimiter = re.escape(self.quote), re.escape(self.delimiter)
        space = " *+" if self.skip_space else ""
        quoted = f"(?:[^{quote}]|{quote}{quote})*+{quote}(?!{quote})[^{delimiter}]*+"
        cell = f"(?:{space}{quote}{quoted}|(?!{space}{quote})[^{delimiter}]*+)"
        return re.compile(f"{cell}(?:{delimiter}{cell})*+", re.DOTALL), re.compile(f"{quoted}(?:{delimiter}{cell})*+", re.DOTALL)

    def stepper(self) -> Callable[[str, int], int]:
        outside, inside = self.patterns()
        quote = self.quote

        def step(line: str, state: int) -> int:
            if quote not in line:
                return state
            return 0 if (inside if state else outside).fullmatch(line) else 1

        return step

    def effect(self, lines: Iterable[str]) -> list[int]:
        step, one, two = self.stepper(), 0, 1
        for line in lines:
            if self.quote in line:
                one, two = (step(line, one), step(line, two)) if one != two else [step(line, one)] * 2
        return [one, two]

    def applied(self, effect: list[int], state: State) -> State:
        return (effect[state[0]],)

    def goes_on(self, state: State) -> bool:
        return state[0] == 1

    def trouble(self, state: State) -> str | None:
        return None

    def rows(self, lines: Iterable[str]) -> Iterator[list[str]]:
        csv.field_size_limit(2**31 - 1)
        return csv.reader(lines, delimiter=self.delimiter, quotechar=self.quote, skipinitialspace=self.skip_space)

    def read(self, lines: Lines, state: State, first: bool, single: bool) -> Iterator[Found]:
        step, inside, piece, at = self.stepper(), state[0], [], -1
        while inside:
            place = next(lines, None)
            if place is None:
                break
            at = place[0] if at < 0 else at
            piece.append(place[1])
            inside = step(place[1], inside)
        if piece:
            yield Found(at, piece="\n".join(piece), place=0)
        record: list[tuple[int, str]] = []

        def fed() -> Iterator[str]:
            for place in lines:
                record.append(place)
                yield place[1] + "\n"

        waiting = None
        for cells in self.rows(fed()):
            if waiting is not None:
                yield waiting
            waiting, last = Found(record[0][0], cells=cells), list(record)
            record.clear()
            if first and any(cell.strip() for cell in cells):
                # The header.
                waiting, first = None, False
        if waiting is not None:
            left = 0
            for _, line in last:
                left = step(line, left)
            if left and not single:
                waiting = Found(waiting.line, piece="\n".join(line for _, line in last))
            yield waiting


# --------------------------------------------------------------------- JSON
TOKENS = re.compile(r'"(?:[^"\\]|\\.)*+"|["\[\]{}]', re.DOTALL)
STRING_END = re.compile(r'(?:[^"\\]|\\.)*+"', re.DOTALL)
#: What stands at one place of an array: an object without nested values, up to the comma or bracket that ends it.
FLAT = re.compile(r'\s*+\{(?:[^"{}\[\]]++|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+\}\s*+(?=[,\]])', re.DOTALL)
MARKS = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|["\[\]{},]', re.DOTALL)
BEFORE, WITHIN, BEYOND = range(3)


@dataclass(frozen=True)
class JsonItems:
    """Items of the first array of a JSON text that is cut at every comma.

    The state is where a line starts (before, within or beyond the array), whether inside a
    string, and how many brackets are open from the array's own on.
    """

    start: State = (BEFORE, 0, 0)
    joint: str = ","

    @staticmethod
    def brackets(line: str, inside: int) -> tuple[int, list[tuple[int, int]]]:
        """Whether the line ends inside a string, and places of brackets outside strings: 1, 2 open, -1 closes."""
        at = 0
        if inside:
            end = STRING_END.match(line)
            if end is None:
                return 1, []
            at = end.end()
        found = []
        for token in TOKENS.finditer(line, at):
            text = token.group()
            if text == '"':
                return 1, found
            if len(text) == 1:
                found.append((token.start(), 2 if text == "[" else 1 if text == "{" else -1))
        return 0, found

    def effect(self, lines: Iterable[str]) -> list[int]:
        """For a start outside and inside a string: inside at the end; change and least of the depth; the same from the first array on, if one opens."""
        now = [[0, 0, 0, 0, 0, 0], [1, 0, 0, 0, 0, 0]]
        for line in lines:
            told = {inside: self.brackets(line, inside) for inside in {now[0][0], now[1][0]}}
            for sums in now:
                sums[0], found = told[sums[0]]
                for _, kind in found:
                    step = -1 if kind < 0 else 1
                    sums[1] += step
                    sums[2] = min(sums[2], sums[1])
                    if sums[3]:
                        sums[4] += step
                        sums[5] = min(sums[5], sums[4])
                    elif kind == 2:
                        sums[3:] = [1, 1, 1]
        return now[0] + now[1]

    def applied(self, effect: list[int], state: State) -> State:
        where, inside, depth = state
        end, change, least, opens, after, after_least = effect[6:] if inside else effect[:6]
        if where == BEYOND or where == WITHIN and depth + least <= 0 or where == BEFORE and opens and after_least <= 0:
            return BEYOND, 0, 0
        if where == WITHIN:
            return WITHIN, end, depth + change
        return (WITHIN, end, after) if opens else (BEFORE, end, 0)

    def goes_on(self, state: State) -> bool:
        return state[0] == WITHIN and state[1:] != (0, 1)

    def trouble(self, state: State) -> str | None:
        return {BEFORE: "no array in the JSON text", WITHIN: "the JSON array cannot be read"}.get(state[0])

    def read(self, lines: Lines, state: State, first: bool, single: bool) -> Iterator[Found]:
        where, inside, depth = state
        carried = self.goes_on(state)
        item, at = [], -1
        for line_at, line in lines:
            if where == BEYOND:
                break
            inside, found = self.brackets(line, inside)
            begin, end = 0, None
            for place, kind in found:
                if where == BEFORE:
                    if kind == 2:
                        where, depth, begin = WITHIN, 1, place + 1
                    continue
                depth += -1 if kind < 0 else 1
                if depth == 0:
                    where, end = BEYOND, place
                    break
            if where == BEFORE:
                continue
            at = line_at if at < 0 else at
            item.append(line[begin:end])
            if where == BEYOND or depth == 1 and not inside:
                text = ",".join(item)
                if carried:
                    yield Found(at, piece=text, place=0)
                elif text.strip():
                    yield Found(at, cells=[text])
                item, at, carried = [], -1, False
        if single and where != BEYOND:
            yield Found(0, error=self.trouble((where,)))
        elif item:
            yield Found(at, piece=",".join(item), place=0 if carried else 1)

    def whole(self, text: str) -> tuple[list[int], list[str], str | None]:
        """Places and texts of the items of a whole file, and what is wrong with it; as :meth:`read` gives them."""
        places: list[int] = []
        texts: list[str] = []
        opening = next((mark for mark in MARKS.finditer(text) if mark.group() in ("[", '"')), None)
        if opening is None or opening.group() == '"':
            return places, texts, self.trouble((BEFORE,))
        begin = opening.end()
        while True:
            flat = FLAT.match(text, begin)
            end = flat.end() if flat else self._end_of_item(text, begin)
            if end is None:
                return places, texts, self.trouble((WITHIN,))
            item = text[begin:end]
            if item.strip():
                places.append(begin)
                texts.append(item)
            if text[end] != ",":
                return places, texts, None
            begin = end + 1

    @staticmethod
    def _end_of_item(text: str, begin: int) -> int | None:
        """Place of the comma or bracket that ends an item; None if there is none."""
        depth = 1
        for mark in MARKS.finditer(text, begin):
            sign = mark.group()
            if sign == '"':
                return None
            if sign == "," and depth == 1:
                return mark.start()
            if sign in ("[", "{"):
                depth += 1
            elif sign in ("]", "}"):
                depth -= 1
                if not depth:
                    return mark.start()
        return None
