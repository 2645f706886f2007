from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.llm import negatives, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score string, _shard int"


def brute_force(rows, anchors, low=30, high=90):
    """All pairs, from the definition."""
    usable = [
        (i, [math.floor(256 * x) for x in v], label)
        for i, v, label, *_ in rows
        if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = lambda pair: (-pair[0], pair[1] is None, pair[1] or 0)
    found = []
    for i, v, label in usable:
        if i is None or i % anchors:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other == label) for j, w, other in usable if j != i]
        positives = sorted((x for x in scored if x[2]), key=order)[:5]
        rest = sorted((x for x in scored if not x[2]), key=order)
        for p, j, _ in positives:
            fit = [x for x in rest if low * p <= 100 * x[0] <= high * p][:10]
            found += [(i, j, rank, x[1], p, x[0]) for rank, x in enumerate(fit, 1)]
    return found


def result(df):
    key = lambda row: tuple((x is None, x or 0) for x in row)
    return sorted((tuple(row) for row in df.collect()), key=key), key


def some_rows(seed: int, count: int, size: int = 6):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    rows = []
    for n in range(count):
        centre, scale = draw.choice(centres), draw.choice([0.1, 0.3, 1, 1, 4])
        vector = [float(np.float32(scale * (x + draw.gauss(0, 0.4)))) for x in centre]
        rows.append((n, vector, draw.randrange(3), "clash", 1))
    # Copies, ties, zero vectors and rows that take no part.
    rows += [(1000 + n, rows[10][1], n % 3, None, None) for n in range(60)]
    rows += [(2000, [0.0] * size, 1, None, None), (2001, [math.nan] * size, 1, None, None), (2002, None, 1, None, None)]
    rows += [(2003, [1.0, None] + [0.0] * (size - 2), 1, None, None), (2004, rows[0][1], None, None, None), (None, rows[10][1], 1, None, None)]
    rows += [(2005, [math.inf] + [0.0] * (size - 1), 1, None, None), (2006, rows[3][1][:2], 1, None, None)]
    return rows


@pytest.mark.parametrize("seed, shard", [(1, 1 << 22), (2, 300)])
def test_same_as_all_pairs(spark, seed, shard, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", shard)
    monkeypatch.setattr(vectors, "STEP", 16)
    monkeypatch.setattr(vectors, "SAMPLE", 20)
    rows = some_rows(seed, 300)
    got, key = result(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 10 == 0))
    want = sorted(brute_force(rows, 10), key=key)
    assert len(want) > 500
    assert got == want


def test_no_rows_and_lone_rows(spark):
    none = negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0)
    assert none.collect() == [] and none.columns[:3] == ["anchor_id", "positive_id", "rank"]
    lone = [(0, [1.0, 0.0], 1, None, None), (10, [], 1, None, None), (None, None, None, None, None)]
    assert negatives.hard_negatives(spark.createDataFrame(lone, SCHEMA), F.col("vec_id") % 10 == 0).collect() == []


def test_repeated_anchor_rows_are_answered_each(spark):
    rows = [(0, [1.0, 0.0], 1, None, None)] * 2 + [(1, [1.0, 0.1], 1, None, None), (2, [0.5, 0.0], 2, None, None)]
    got = [tuple(row) for row in negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect()]
    assert got == [(0, 1, 1, 2, 65536, 32768)] * 2


def test_scores_beyond_doubles_are_exact():
    draw = np.random.default_rng(0)
    for size in (10, 2**28, 2**40):
        some = draw.integers(-size, size, (20, 5))
        others = draw.integers(-size, size, (30, 5))
        want = [[max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(x, y)))) for y in others] for x in some]
        assert negatives.scores(*negatives.exact(some, others)).tolist() == want


def test_pruning_skips_rows_and_loses_none():
    """Of what a bucket leaves out, nothing reaches the bound; on clustered rows it leaves out most."""
    draw = np.random.default_rng(3)
    rows = (draw.normal(size=(20, 16))[draw.integers(0, 20, 5000)] * 200 + draw.normal(size=(5000, 16)) * 20).astype(np.int64)
    looked = total = 0
    for anchor in rows[:50]:
        score, length = rows @ anchor, float(np.sqrt(anchor @ anchor))
        bound = int(np.sort(score)[-10])
        kept: set[int] = set()
        for bucket in negatives.buckets(rows):
            near = negatives.feasible(bucket, anchor, length, bound)
            if near is None:
                break
            kept |= set(near.tolist())
        assert kept >= set(np.flatnonzero(score >= bound).tolist())
        looked, total = looked + len(kept), total + len(rows)
    assert looked < 0.3 * total
