from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.llm import neighbours, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, score string, rank int, _block int"


def brute_force(rows, every=50, most=5):
    usable = [(i, v) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    size = lambda v: math.sqrt(sum(x * x for x in v))
    found = []
    for i, v in usable:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)) / (size(v) * size(w)), j) for j, w in usable if j != i]
        scored.sort(key=lambda pair: (-pair[0], pair[1] is None, pair[1] or 0))
        found += [(i, rank, j, score) for rank, (score, j) in enumerate(scored[:most], 1)]
    return sorted(found)


def clustered(seed: int, count: int, size: int, clusters: int):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(clusters, size))
    return centres[draw.integers(0, clusters, count)] + 0.25 * draw.normal(size=(count, size))


def some_rows(seed: int):
    draw = random.Random(seed)
    rows = [(n, v, 1, "clash", None, 3) for n, v in enumerate(clustered(seed, 400, 8, 6).tolist())]
    # A third are copies of one row, some ids repeat, and some take no part.
    rows += [(5000 - n, rows[7][1], 1, None, None, None) for n in range(200)]
    rows += [(n, [2 * x for x in rows[100][1]], 1, None, None, None) for n in (901, 902)]
    rows += [(None, rows[50][1], 1, None, None, None), (None, None, None, None, None, None), (950, [0.0] * 8, 1, None, None, None)]
    rows += [(1000, [math.nan] * 8, 1, None, None, None), (1050, [None] * 8, 1, None, None, None), (1100, [], 1, None, None, None)]
    rows += [(1150, [math.inf] + [0.0] * 7, 1, None, None, None), (1200, [1.0, 2.0], 1, None, None, None)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, shard, leaf", [(1, 1 << 22, 64), (2, 800, 8)])
def test_factor_one_is_exact(spark, seed, shard, leaf, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", shard)
    monkeypatch.setattr(vectors, "STEP", 5)
    monkeypatch.setattr(vectors, "SAMPLE", 30)
    monkeypatch.setattr(neighbours, "LEAF", leaf)
    rows = some_rows(seed)
    got = sorted(tuple(r) for r in neighbours.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 50 == 0).collect())
    want = brute_force(rows)
    assert [row[:3] for row in got] == [row[:3] for row in want]
    assert [row[3] for row in got] == pytest.approx([row[3] for row in want], abs=1e-15)


def test_few_and_no_rows(spark):
    none = neighbours.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0)
    assert none.collect() == [] and none.columns == ["query_id", "rank", "vec_id", "score"]
    rows = [(0, [1.0, 0.0], None, None, None, None), (0, [1.0, 0.0], None, None, None, None), (3, [1e200, 1e200], None, None, None, None)]
    got = [tuple(r) for r in neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()]
    assert got == [(0, 1, 3, pytest.approx(math.sqrt(0.5)))] * 2
    assert neighbours.nearest(spark.createDataFrame(rows[:1], SCHEMA), F.col("vec_id") % 50 == 0).collect() == []


def searched(points: np.ndarray, factor: float) -> tuple[float, float]:
    """Recall of the five nearest, and the share of all pairs that were looked at."""
    points = neighbours.unit(points)
    asked = points[::50]
    root = neighbours.tree(points, np.arange(len(points)), np.random.default_rng(0))
    run = neighbours.Search(points, root, asked, np.full(len(asked), np.inf), 5, factor)
    run.run()
    want = np.argsort(neighbours.distances(asked, points), axis=1)[:, :5]
    recall = np.mean([len(set(a) & set(b)) / 5 for a, b in zip(run.entry[:, :5].tolist(), want.tolist())])
    return float(recall), run.looked / (len(points) * len(asked))


def test_factor_trades_recall_for_work():
    points = clustered(5, 6000, 32, 60)
    exact, work = searched(points, 1.0)
    relaxed, less = searched(points, 2.0)
    assert exact == 1.0 and work < 0.6
    assert relaxed >= 0.9 and less < 0.7 * work


def test_many_equal_rows_are_one_entry():
    """Copies don't deepen the tree or make it fail where no distance tells rows apart."""
    same = np.ones((500, 4))
    root = neighbours.tree(neighbours.unit(same), np.arange(500), np.random.default_rng(0))
    run = neighbours.Search(neighbours.unit(same), root, neighbours.unit(same[:3]), np.full(3, np.inf), 6, 1.0)
    run.run()
    assert run.entry[:, :6].tolist() == [[0, 1, 2, 3, 4, 5]] * 3
