"""Distributed packing equals a sequential fold, whatever the partitioning."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweir.operators import packing
from logweir.operators.packing import (
    NO_LIMIT,
    Limits,
    Piece,
    after,
    composed,
    entry_table,
    forced_group,
    index_rows,
    label_run,
    pack_rows,
    states_before,
)
from logweir.operators.segments import build_chunks, segment_rows


def fold(weights, budget, max_rows):
    labels, group, rows, used = [], -1, 0, 0
    for weight in weights:
        if group < 0 or rows >= max_rows or used + weight > budget:
            group, rows, used = group + 1, 0, 0
        rows, used = rows + 1, used + weight
        labels.append(group)
    return labels


@settings(max_examples=400, deadline=None)
@given(
    weights=st.lists(st.integers(1, 12), min_size=1, max_size=40),
    budget=st.integers(1, 30),
    max_rows=st.sampled_from([NO_LIMIT, 2, 3, 8]),
    cuts=st.sets(st.integers(1, 39), max_size=5),
)
def test_labels_and_tables_across_cuts(weights, budget, max_rows, cuts):
    limits, state, labels = Limits(budget, max_rows), None, []
    bounds = [0, *sorted(cut for cut in cuts if cut < len(weights)), len(weights)]
    for start, end in zip(bounds[:-1], bounds[1:]):
        part = np.array(weights[start:end])
        found, left = label_run(part, state, limits)
        # The small table of a partition gives the same exit state as its rows.
        assert after(piece("k", part, limits), state, limits) == left
        labels.extend(found.tolist())
        state = left
    assert labels == fold(weights, budget, max_rows)


def piece(key, weights, limits):
    return Piece(key, key, len(weights), int(weights.sum()), entry_table(weights, limits), None)


@settings(max_examples=300, deadline=None)
@given(
    runs=st.lists(st.tuples(st.sampled_from("aab"), st.lists(st.integers(1, 12), min_size=1, max_size=9)), min_size=2, max_size=9),
    budget=st.sampled_from([1, 5, 17, 30, NO_LIMIT]),
    max_rows=st.sampled_from([NO_LIMIT, 2, 3, 8]),
    draw=st.randoms(use_true_random=False),
)
def test_composition_is_the_fold_in_any_order(runs, budget, max_rows, draw):
    limits, key = Limits(budget, max_rows), None
    pieces = [piece(name, np.array(weights), limits) for name, weights in runs]
    state, before = None, []
    for name, weights in runs:
        state = state if name == key else None
        before.append(None if state is None else tuple(state))
        _, state = label_run(np.array(weights), state, limits)
        key = name
    assert [entry for entry, _ in states_before(pieces, (None, None), limits)] == before
    # Any two neighbours may be put together first.
    while len(pieces) > 1:
        at = draw.randrange(len(pieces) - 1)
        pieces[at : at + 2] = [composed(pieces[at], pieces[at + 1], limits)]
        assert pieces[at].table is None or len(pieces[at].table) <= 2 * min(budget, max_rows)
    assert after(pieces[0], None, limits) == state


def test_tables_of_two_thousand_partitions_of_one_key_stay_small():
    draw, limits, whole, state = np.random.default_rng(0), Limits(6000), None, None
    for _ in range(2000):
        weights = draw.integers(1, 400, 300)
        one = piece("hot", weights, limits)
        whole = one if whole is None else composed(whole, one, limits)
        _, state = label_run(weights, state, limits)
        # What a block of pieces sends on is never more than the lines a single partition may have.
        assert len(whole.table) <= 6000
    assert after(whole, None, limits) == state
    # Groups begun at different rows have fallen into step long since.
    assert len(whole.table) < 300


@pytest.mark.parametrize(("fan", "partitions"), [(2, 41), (3, 200)])
def test_prefix_over_many_partitions(spark, fan, partitions, monkeypatch):
    """One key holds nearly all partitions; whatever is composed where, it is the sequential fold."""
    monkeypatch.setattr(packing, "FAN", fan)
    seen = []
    states = packing.states_before
    monkeypatch.setattr(packing, "states_before", lambda pieces, *rest: seen.append(len(pieces)) or states(pieces, *rest))
    rng = random.Random(fan)
    rows = [("hot" if i < 2900 else "z" if i < 2950 else None, i, rng.choice([1, 5, 60, 120, 400])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, pos long, t long").repartition(5)
    got = {row.pos: (row.group_index, row.row_index) for row in pack_rows(df, "k", ["pos"], F.col("t"), 256, NO_LIMIT, partitions).collect()}
    for start, end in [(0, 2900), (2900, 2950), (2950, 3000)]:
        labels = fold([row[2] for row in rows[start:end]], 256, NO_LIMIT)
        assert [got[start + i] for i in range(end - start)] == [(label, i) for i, label in enumerate(labels)]
    # The driver folds no more pieces than one block has.
    assert seen == [seen[0]] and seen[0] <= fan


@pytest.mark.parametrize(("partitions", "max_rows"), [(1, NO_LIMIT), (7, NO_LIMIT), (13, 8), (60, 3)])
def test_pack_rows_with_a_hot_key(spark, partitions, max_rows):
    rng = random.Random(partitions)
    rows = [(rng.choice("aaaaaabcd"), i, rng.choice([1, 5, 60, 120, 400])) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, pos long, t long").repartition(5)
    packed = pack_rows(df, "k", ["pos"], F.col("t"), 256, max_rows, partitions).orderBy("k", "pos").collect()
    expected = []
    for key in sorted({row[0] for row in rows}):
        own = sorted(row for row in rows if row[0] == key)
        labels = fold([row[2] for row in own], 256, max_rows)
        expected += [(*row, label, i) for i, (row, label) in enumerate(zip(own, labels))]
    assert [tuple(row) for row in packed] == expected


def test_pack_rows_with_integer_keys_and_index(spark):
    df = spark.range(300).select((F.col("id") % 7).cast("int").alias("k"), F.col("id").alias("pos"))
    rows = index_rows(df, "k", ["pos"], partitions=9).collect()
    assert all(row.row_index == row.pos // 7 for row in rows)


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_segments_equal_a_sequential_join(spark, partitions):
    rng = random.Random(partitions)
    rows = [
        (rng.choice(["hot"] * 5 + ["b", "c"]), i, rng.choice(["", f"t{i:05}"]), "x" * rng.randint(1, 300) + "é\U0001f600")
        for i in range(900)
    ]
    df = spark.createDataFrame(rows, "job_id string, pos long, timestamp string, raw_line string")
    for name in ("end_time", "namespace", "container_name", "pod_name"):
        df = df.withColumn(name, F.lit(""))
    df = df.withColumn("attrs", F.create_map().cast("map<string,string>"))
    found = {(row.job_id, row.segment_index): row for row in segment_rows(df, "job_id", ["pos"], 10, partitions=partitions).collect()}
    expected = {}
    for key in sorted({row[0] for row in rows}):
        own = sorted(row for row in rows if row[0] == key)
        lines = [(f"[{row[2]} -> {row[2]}]  " if row[2] else "") + row[3] for row in own]
        # The budget is never below 256.
        for label, line, row in zip(fold([max(1, math.ceil(len(line) / 2.2)) for line in lines], 256, NO_LIMIT), lines, own):
            expected.setdefault((key, label), []).append((line, row[2]))
    assert set(found) == set(expected)
    for place, members in expected.items():
        row, times = found[place], [time for _, time in members if time]
        assert row.content == "\n".join(line for line, _ in members)
        assert (row.rows_count, row.chars) == (len(members), len(row.content))
        assert json.loads(row.metadata) == {"first_timestamp": (times or [""])[0], "last_timestamp": (times or [""])[-1]}


@pytest.mark.parametrize(("n", "g", "sizes"), [(9, 8, [7, 2]), (17, 8, [8, 7, 2]), (4, 2, [2, 2]), (5, 2, [2, 2, 1]), (16, 8, [8, 8]), (1, 8, [1])])
def test_forced_groups(spark, n, g, sizes):
    groups = spark.range(n).select(forced_group(F.col("id"), F.lit(n), g).alias("g")).groupBy("g").count().orderBy("g")
    assert [row["count"] for row in groups.collect()] == sizes


def units(text):
    clean = text.replace("\r\n", "\n").replace("\r", "\n").strip()
    paragraphs = [part.strip() for part in clean.split("\n\n") if part.strip()]
    if len(paragraphs) > 1 or not clean:
        return paragraphs
    return [line.strip() for line in clean.splitlines() if line.strip()]


def test_chunks_equal_a_sequential_join(spark):
    rng = random.Random(2)
    pieces = ["word " * 40, "\n\n", "\n", "\r\n", " ", "x" * 1300, "\x1c", "éé \U0001f600", " \x85 "]
    texts = ["", " \n ", *["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(60)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {}
    for row in build_chunks(df, "id", "text", 300).orderBy("id", "chunk_index").collect():
        found.setdefault(row.id, []).append(row.content)
    for i, text in enumerate(texts):
        cut = []
        for unit in units(text):
            cut += [unit] if len(unit) <= 600 else [p for p in (unit[k : k + 600].strip() for k in range(0, len(unit), 600)) if p]
        chunks = {}
        for label, piece in zip(fold([max(1, math.ceil(len(piece) / 2.2)) for piece in cut], 300, NO_LIMIT), cut):
            chunks.setdefault(label, []).append(piece)
        assert found.get(i, []) == ["\n\n".join(chunk) for chunk in chunks.values()]


def test_a_row_number_needs_one_line_a_partition():
    assert len(entry_table(np.ones(1_000_000, dtype=np.int64), Limits(NO_LIMIT))) == 1
