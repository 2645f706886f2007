from __future__ import annotations

import math
import random

import numpy as np
import pytest

from logweir.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, n string, component int"


def brute_force(vectors):
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(column) for column in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[a - s / n for a, s in zip(row, sums)] for row in x])
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    values, columns = values[::-1], columns[:, ::-1]
    most = min(8, len(values))
    return deviation, centred @ columns[:, :most] / np.sqrt(values[:most]), values[:most] / values.sum()


def some_rows(seed: int, count: int, size: int):
    draw = random.Random(seed)
    vectors = [[draw.gauss(0, 1 + k) + draw.choice([0, 3]) for k in range(size)] for _ in range(count)]
    rows = [(n, v, 1, "clash", 7) for n, v in enumerate(vectors)]
    out = [(9000, None, 1, None, None), (9001, [None] + vectors[0][1:], 1, None, None), (9002, [math.nan] * size, 1, None, None)]
    out += [(9003, [math.inf] + vectors[0][1:], 1, None, None), (9004, vectors[0][1:], 1, None, None), (9005, [1e200] * size, 1, None, None)]
    return rows, out, vectors


@pytest.mark.parametrize("seed, size", [(1, 12), (2, 3), (3, 1)])
def test_same_as_the_definition(spark, seed, size):
    rows, out, vectors = some_rows(seed, 300, size)
    rows = rows + [(None, vectors[5], None, None, None), rows[7]]
    vectors = vectors + [vectors[5], vectors[7]]
    got = whitening.whiten(spark.createDataFrame(rows + out, SCHEMA).repartition(4)).toPandas()
    deviation, whitened, explained = brute_force(vectors)
    most = min(8, size)
    assert len(got) == len(vectors) * most and set(got["n"]) == {len(vectors)}
    assert sorted(got[got["component"] == 1]["deviation"]) == sorted(deviation)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    for k in range(most):
        part = got[got["component"] == k + 1]
        assert part["explained"].iloc[0] == pytest.approx(explained[k], rel=1e-9)
        one, two = np.sort(part["whitened"]), np.sort(whitened[:, k])
        assert min(np.abs(one - two).max(), np.abs(one - np.sort(-whitened[:, k])).max()) < 1e-8
        some = part.dropna(subset="vec_id").drop_duplicates("vec_id").set_index("vec_id").loc[range(300), "whitened"].to_numpy()
        assert abs(some @ whitened[:300, k]) == pytest.approx(np.linalg.norm(some) * np.linalg.norm(whitened[:300, k]))


def test_no_rows_one_row_and_flat_dimensions(spark):
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and len(empty.columns) == 7
    nulls = [(1, None, None, None, None), (2, [None], None, None, None)]
    assert whitening.whiten(spark.createDataFrame(nulls, SCHEMA)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0], None, None, None)], SCHEMA)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = [(n, [float(n), 4.0, -float(n)], None, None, None) for n in range(5)]
    got = whitening.whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {r.component for r in got if r.whitened is not None} == {1} and len(got) == 15
    assert sum(r.whitened**2 for r in got if r.component == 1) / 5 == pytest.approx(1)
    assert got[0].identity_error < 1e-12


def test_sums_that_no_long_holds(spark):
    """Entries near the end of their range: squares are summed in full."""
    big = 2.0**38
    rows = [(n, [big * (-1) ** n, big * (n % 3 - 1), float(n)], None, None, None) for n in range(30)]
    deviation, whitened, explained = brute_force([row[1] for row in rows])
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert max(deviation) >= 2**63 and got["deviation"].isna().any()
    first = got[got["component"] == 1].sort_values("vec_id")
    assert np.abs(np.abs(first["whitened"].to_numpy()) - np.abs(whitened[:, 0])).max() < 1e-9
    assert first["explained"].iloc[0] == pytest.approx(explained[0])


def test_polarised_covariances_are_exact(spark):
    draw = np.random.default_rng(4)
    data = draw.normal(size=(200, 6)) @ draw.normal(size=(6, 6))
    rows = spark.createDataFrame([(n, v, None, None, None) for n, v in enumerate(data.tolist())], SCHEMA)
    n, sums = whitening.means(rows, "embedding")
    x = np.floor(1024 * data).astype(np.int64) + 100000
    assert (n, sums) == (200, x.sum(axis=0).tolist())
    wide = n * x.astype(object) - np.array(sums, object)
    want = (wide.T @ wide) / float(n) ** 3
    assert whitening.covariances(rows, "embedding", n, sums) == pytest.approx(want.astype(float), rel=1e-14)
