"""Greedy packing of ordered rows into budgeted groups, exact for keys of any size.

A group is closed when the next row would take its token sum over the budget, or
when it has ``max_rows`` rows. Every boundary depends on all earlier rows of the
key, so neither a window nor a running sum gives it. Folding each key in one task
would, but a key may hold a large share of all rows. So:

1. rows are range-partitioned and sorted by (key, order) and checkpointed, so that
   both passes see the same partitions;
2. each partition reports, in one small row, how it maps the state at its start to
   the state at its end. Only a partition lying wholly inside one key depends on
   its entry state at all, and then only through which of its first rows opens the
   next group: a short table with one line per distinct outcome;
3. two such rows that follow each other make one row of the same kind, so the rows are
   composed in blocks over the executors, round by round, until a few are left. From the
   states before those, the states before their members are found on the way back;
4. each partition labels its rows, starting from its true entry state.

No task ever holds more than its own partition or one block of such rows. The driver sees
the last few rows and one state a partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.session import cut

NO_LIMIT = 2**62
#: Pieces that are composed at once, and that are left to the driver at the end.
FAN = 32

PART = "_part"
WEIGHT = "_weight"


class Open(NamedTuple):
    """The group that is open at some point of a key, and the rows seen so far."""

    group: int
    rows: int
    tokens: int
    seen: int


@dataclass(frozen=True)
class Limits:
    budget: int
    max_rows: int = NO_LIMIT

    @property
    def endless(self) -> bool:
        return self.budget >= NO_LIMIT and self.max_rows >= NO_LIMIT

    def end_of_group(self, sums: np.ndarray, start: int, rows: int = 0, tokens: int = 0) -> int:
        """First row from ``start`` that no longer fits a group with rows and tokens in it."""
        base = sums[start - 1] if start else 0
        end = int(np.searchsorted(sums, base + self.budget - tokens, side="right"))
        end = min(end, start + self.max_rows - rows, len(sums))
        return max(end, start) if rows else max(end, start + 1)


def label_run(weights: np.ndarray, entry: Open | None, limits: Limits) -> tuple[np.ndarray, Open]:
    """Group index of each row of one key run, and the state after it."""
    n = len(weights)
    sums = np.cumsum(weights)
    labels = np.empty(n, dtype=np.int64)
    group, rows, tokens, seen = entry or (-1, 0, 0, 0)
    at = 0
    if entry is not None:
        at = limits.end_of_group(sums, 0, rows, tokens)
        labels[:at] = group
        rows, tokens = rows + at, tokens + (int(sums[at - 1]) if at else 0)
    while at < n:
        end = limits.end_of_group(sums, at)
        group += 1
        labels[at:end] = group
        rows, tokens = end - at, int(sums[end - 1] - (sums[at - 1] if at else 0))
        at = end
    return labels, Open(group, rows, tokens, seen + n)


def entry_table(weights: np.ndarray, limits: Limits) -> np.ndarray:
    """How a run answers to every possible entry state.

    One line ``(row, sum, groups, rows, tokens)`` per distinct outcome: if the first
    row that does not fit the open group is at most ``row`` (whose running token sum
    is ``sum``), the run opens ``groups`` more groups and leaves ``rows`` rows with
    ``tokens`` tokens in the last one. Where no line applies, the whole run fits.
    """
    n = len(weights)
    sums = np.cumsum(weights)
    if limits.endless:
        # Nothing ever closes a group, so the run goes on with any that is open: one line.
        return np.array([(0, int(weights[0]), 1, n, int(sums[-1]))], dtype=np.int64)
    before = sums - weights
    reachable = int(np.searchsorted(before, limits.budget, side="left"))
    reachable = max(1, min(reachable, limits.max_rows, n))
    outcome: dict[int, tuple[int, int, int]] = {}
    table: list[tuple[int, int, int, int, int]] = []
    for first in range(reachable):
        path = []
        at = first
        while at < n and at not in outcome:
            path.append(at)
            at = limits.end_of_group(sums, at)
        after = outcome.get(at)
        for start in reversed(path):
            if after is None:
                after = (1, n - start, int(sums[-1] - before[start]))
            else:
                after = (after[0] + 1, after[1], after[2])
            outcome[start] = after
        table.append((first, int(sums[first]), *outcome[first]))
    return pruned(np.array(table, dtype=np.int64), limits)


def pruned(table: np.ndarray, limits: Limits) -> np.ndarray:
    """A table without the lines that no open group reaches, and one line per run of equal outcomes."""
    if limits.endless:
        return table[:1]
    # An open group has one row and one token at least, so this line applies to every one.
    always = (table[:, 0] + 1 >= limits.max_rows) | (table[:, 1] + 1 > limits.budget)
    if always.any():
        table = table[: int(always.argmax()) + 1]
    last = np.append((table[1:, 2:] != table[:-1, 2:]).any(axis=1), True)
    return table[last]


class Piece(NamedTuple):
    """How rows that follow each other map the state before them to the state after them.

    Rows of one key have a ``table``. With more keys the state after them is that of the
    last key, ``tail``, whatever came before.
    """

    head_key: object
    tail_key: object
    rows: int
    total: int
    table: np.ndarray | None
    tail: Open | None


def after(piece: Piece, entry: Open | None, limits: Limits) -> Open:
    """State after a piece whose first key is open with ``entry``, or begins with it."""
    if piece.table is None:
        return piece.tail
    if entry is None:
        _, _, groups, rows, tokens = piece.table[0].tolist()
        return Open(groups - 1, rows, tokens, piece.rows)
    moved = _through(piece, np.array([[0, entry.rows, entry.tokens]], dtype=np.int64), limits)[0].tolist()
    return Open(entry.group + moved[0], moved[1], moved[2], entry.seen + piece.rows)


def _through(piece: Piece, states: np.ndarray, limits: Limits) -> np.ndarray:
    """States ``(groups, rows, tokens)`` after a piece of one key, one for each state before it."""
    table = piece.table
    groups, rows, tokens = states.T
    # Rows and sums rise from line to line, so the first line that applies is found by bisection.
    line = np.minimum(
        np.searchsorted(table[:, 0], limits.max_rows - rows, side="left"),
        np.searchsorted(table[:, 1], limits.budget - tokens, side="right"),
    )
    fits = line == len(table)
    found = table[np.minimum(line, len(table) - 1)]
    return np.stack(
        [
            np.where(fits, groups, groups + found[:, 2]),
            np.where(fits, rows + piece.rows, found[:, 3]),
            np.where(fits, tokens + piece.total, found[:, 4]),
        ],
        axis=1,
    )


def composed(first: Piece, second: Piece, limits: Limits) -> Piece:
    """Two pieces that follow each other as one; this is associative."""
    rows, total = first.rows + second.rows, first.total + second.total
    goes_on = first.tail_key == second.head_key
    if second.table is None or first.table is None or not goes_on:
        before = after(first, None, limits) if goes_on and second.table is not None else None
        return Piece(first.head_key, second.tail_key, rows, total, None, after(second, before, limits))
    moved = _through(second, first.table[:, 2:], limits)
    later = second.table.copy()
    later[:, 0] += first.rows
    later[:, 1] += first.total
    table = np.concatenate([np.concatenate([first.table[:, :2], moved], axis=1), later])
    return Piece(first.head_key, second.tail_key, rows, total, pruned(table, limits), None)


def key_runs(keys: pa.Array) -> np.ndarray:
    """Offsets at which the key changes, with 0 and the length at the ends."""
    n = len(keys)
    if n < 2:
        return np.array([0, n])
    later, former = keys.slice(1), keys.slice(0, n - 1)
    same = np.asarray(pc.equal(later, former).fill_null(False)) | np.asarray(pc.and_(later.is_null(), former.is_null()))
    return np.concatenate(([0], np.flatnonzero(~same) + 1, [n]))


def _piece_schema(key: str) -> str:
    return f"part int, head_key {key}, tail_key {key}, rows long, total long, tail array<long>, lines array<long>"


def _pieces_table(parts: list[int], pieces: list[Piece], arrow_key: pa.DataType) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(parts, pa.int32()),
            pa.array([piece.head_key for piece in pieces], arrow_key),
            pa.array([piece.tail_key for piece in pieces], arrow_key),
            pa.array([piece.rows for piece in pieces], pa.int64()),
            pa.array([piece.total for piece in pieces], pa.int64()),
            pa.array([None if piece.tail is None else list(piece.tail) for piece in pieces], longs),
            pa.array([None if piece.table is None else piece.table.ravel() for piece in pieces], longs),
        ],
        names=["part", "head_key", "tail_key", "rows", "total", "tail", "lines"],
    )


def _pieces(rows: pa.Table | pa.RecordBatch) -> tuple[list[int], list[Piece]]:
    """Pieces in order, and their numbers."""
    found = []
    for row in rows.to_pylist():
        table = None if row["lines"] is None else np.array(row["lines"], dtype=np.int64).reshape(-1, 5)
        tail = None if row["tail"] is None else Open(*row["tail"])
        found.append((row["part"], Piece(row["head_key"], row["tail_key"], row["rows"], row["total"], table, tail)))
    found.sort(key=lambda pair: pair[0])
    return [part for part, _ in found], [piece for _, piece in found]


def _summarise_partition(limits: Limits, key: str, arrow_key: pa.DataType):
    """One piece per partition."""

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = head = tail = None
        single, weights = True, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            runs = key_runs(keys)
            first, last = keys[0].as_py(), keys[len(keys) - 1].as_py()
            values = batch.column(WEIGHT).to_numpy(zero_copy_only=False)
            if part is None:
                part, head = batch.column(PART)[0].as_py(), first
            elif first != tail:
                single, weights = False, []
            if len(runs) > 2:
                single, weights = False, []
            tail = last
            weights.append(values[runs[-2]:])
        if part is None:
            return
        run = np.concatenate(weights)
        table = entry_table(run, limits) if single else None
        left = None if single else label_run(run, None, limits)[1]
        yield _pieces_table([part], [Piece(head, tail, len(run), int(run.sum()), table, left)], arrow_key)

    return summarise


#: The state before a piece and the key it belongs to; plain, as a task gets it without the classes of this package.
Before = tuple[tuple | None, object]


def states_before(pieces: list[Piece], before: Before, limits: Limits) -> list[Before]:
    """The state before each of the pieces, from the one before the first."""
    found, (state, key) = [], before
    for piece in pieces:
        entry = Open(*state) if state is not None and piece.head_key == key else None
        found.append((None if entry is None else tuple(entry), key))
        state, key = tuple(after(piece, entry, limits)), piece.tail_key
    return found


def _downwards(known: Broadcast, limits: Limits, arrow_key: pa.DataType):
    """The states before the members of each block."""

    def downwards(block: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        numbers, found = _pieces(rows)
        states = states_before(found, known.value[block[0].as_py()], limits)
        return pa.table(
            {
                "part": pa.array(numbers, pa.int32()),
                "state": pa.array([None if state is None else list(state) for state, _ in states], pa.list_(pa.int64())),
                "key": pa.array([key for _, key in states], arrow_key),
            }
        )

    return downwards


def _entry_states(pieces: DataFrame, partitions: int, limits: Limits, arrow_key: pa.DataType) -> dict[int, tuple]:
    """Entry state of each partition that starts inside a key begun earlier.

    A parallel prefix: upwards, blocks of pieces become one piece each; downwards, the
    state before a block gives those before its members.
    """
    levels, width = [cut(pieces)], partitions
    by_block = F.floor(F.col("part") / FAN).cast("int").alias("block")

    def upwards(block: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        _, found = _pieces(rows)
        whole = found[0]
        for piece in found[1:]:
            whole = composed(whole, piece, limits)
        return pa.Table.from_batches([_pieces_table([block[0].as_py()], [whole], arrow_key)])

    while width > FAN:
        levels.append(cut(levels[-1].groupBy(by_block).applyInArrow(upwards, levels[0].schema)))
        width = -(-width // FAN)
    parts, top = _pieces(levels.pop().toArrow())
    entries = dict(zip(parts, states_before(top, (None, None), limits)))
    out = T.StructType.fromDDL("part int, state array<long>").add("key", levels[0].schema["head_key"].dataType) if levels else None

    for level in reversed(levels):
        down = _downwards(level.sparkSession.sparkContext.broadcast(entries), limits, arrow_key)
        states = level.groupBy(by_block).applyInArrow(down, out).collect()
        entries = {row["part"]: (None if row["state"] is None else tuple(row["state"]), row["key"]) for row in states}
    return {part: state for part, (state, _) in entries.items() if state is not None}


@dataclass(frozen=True)
class Labeller:
    """Labels the rows of a partition from its entry state; runs inside tasks."""

    key: str
    limits: Limits
    entries: Broadcast

    def batches(
        self, batches: Iterable[pa.RecordBatch]
    ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Per batch: the batch, its group labels and its row indexes within the key."""
        state, last_key, started = None, None, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(self.key)
            weights = batch.column(WEIGHT).to_numpy(zero_copy_only=False)
            if not started:
                state = self.entry(batch)
                started = True
            elif keys[0].as_py() != last_key:
                state = None
            labels, index = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
            runs = key_runs(keys)
            for start, end in zip(runs[:-1], runs[1:]):
                if start:
                    state = None
                seen = state.seen if state else 0
                labels[start:end], state = label_run(weights[start:end], state, self.limits)
                index[start:end] = np.arange(seen, seen + end - start)
            last_key = keys[n - 1].as_py()
            yield batch, labels, index

    def entry(self, batch: pa.RecordBatch) -> Open | None:
        state = self.entries.value.get(batch.column(PART)[0].as_py())
        return Open(*state) if state is not None else None


@dataclass(frozen=True)
class Packed:
    """Range-partitioned, checkpointed rows and the labeller that fits them."""

    rows: DataFrame
    labeller: Labeller


def prepare(
    df: DataFrame,
    key: str,
    order: Sequence[str | Column],
    tokens: Column,
    limits: Limits,
    partitions: int | None = None,
    keep: Sequence[str] | None = None,
) -> Packed:
    """Steps 1 to 3 of the module description; ``keep`` names the columns needed later."""
    spark = df.sparkSession
    bounds = [key, *order]
    weighted = df.withColumn(WEIGHT, F.greatest(tokens.cast("long"), F.lit(1).cast("long")))
    ranged = weighted.repartitionByRange(partitions, *bounds) if partitions else weighted.repartitionByRange(*bounds)
    placed = ranged.sortWithinPartitions(*bounds).withColumn(PART, F.spark_partition_id())
    rows = cut(placed.select(*dict.fromkeys([key, *(keep if keep is not None else df.columns), WEIGHT, PART])))
    key_type = df.schema[key].dataType
    arrow_key = pa.string() if isinstance(key_type, T.StringType) else pa.int64()
    slim = rows.select(PART, F.col(key), WEIGHT)
    if arrow_key == pa.int64():
        key_type = T.LongType()
        slim = slim.withColumn(key, F.col(key).cast("long"))
    pieces = slim.mapInArrow(_summarise_partition(limits, key, arrow_key), _piece_schema(key_type.simpleString()))
    entries = _entry_states(pieces, rows.rdd.getNumPartitions(), limits, arrow_key)
    return Packed(rows, Labeller(key, limits, spark.sparkContext.broadcast(entries)))


def _label(packed: Packed, df: DataFrame) -> DataFrame:
    """Step 4: the rows of ``df`` with group and row index."""
    out_schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("group_index", T.LongType()),
            T.StructField("row_index", T.LongType()),
        ]
    )
    labeller, names = packed.labeller, df.columns

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, labels, index in labeller.batches(batches):
            columns = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(labels), pa.array(index)], names=[*names, "group_index", "row_index"]
            )

    return packed.rows.mapInArrow(label, out_schema)


def _totals(packed: Packed) -> DataFrame:
    """Rows and groups per key; tasks see key and weight only and report each run once."""
    key = packed.labeller.key
    slim = packed.rows.select(key, WEIGHT, PART)
    schema = T.StructType(
        [slim.schema[key], T.StructField("_rows", T.LongType()), T.StructField("_last", T.LongType())]
    )
    labeller = packed.labeller

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, labels, _ in labeller.batches(batches):
            keys = batch.column(key)
            runs = key_runs(keys)
            ends = runs[1:]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(runs[:-1])), pa.array(np.diff(runs)), pa.array(labels[ends - 1])],
                names=[key, "_rows", "_last"],
            )

    counted = slim.mapInArrow(count, schema)
    return counted.groupBy(key).agg(F.sum("_rows").alias("rows_count"), (F.max("_last") + 1).alias("groups_count"))


def pack_rows(
    df: DataFrame,
    key: str,
    order: Sequence[str | Column],
    tokens: Column,
    budget: int,
    max_rows: int = NO_LIMIT,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``group_index`` and ``row_index`` (both from 0 within the key).

    ``key`` is a string or integer column; (key, order) must identify a row. Rows
    weigh at least one token. A row above the budget has a group to itself.
    """
    return _label(prepare(df, key, order, tokens, Limits(budget, max_rows), partitions), df)


def pack_with_totals(
    df: DataFrame,
    key: str,
    order: Sequence[str | Column],
    tokens: Column,
    budget: int,
    max_rows: int = NO_LIMIT,
    partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """:func:`pack_rows`, and ``rows_count`` and ``groups_count`` per key."""
    packed = prepare(df, key, order, tokens, Limits(budget, max_rows), partitions)
    return _label(packed, df), _totals(packed)


def index_rows(df: DataFrame, key: str, order: Sequence[str | Column], partitions: int | None = None) -> DataFrame:
    """``row_index`` within the key: a row number that needs no task per key."""
    return pack_rows(df, key, order, F.lit(1), NO_LIMIT, partitions=partitions).drop("group_index")


def forced_group(row_index: Column, rows: Column, group_size: int) -> Column:
    """Fixed groups of ``group_size``; a lone last row takes its neighbour along."""
    plain = F.floor(row_index / F.lit(group_size)).cast("long")
    if group_size <= 2:
        return plain
    lone_last = (rows > group_size) & (rows % group_size == 1)
    moved = lone_last & (row_index == rows - 2)
    return F.when(moved, plain + 1).otherwise(plain)
