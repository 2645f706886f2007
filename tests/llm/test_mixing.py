from __future__ import annotations

import random

import pytest

from logweir.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, _salt int"


def targets(sizes: dict, percent=150, cap=2, weights=(3, 1, 2)) -> dict:
    """Shares by weight, round by round, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = percent / 100 * sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = sum(weight[s] for s in order if s not in fixed)
        shares = {s: weight[s] * rest / free for s in order if s not in fixed} if free else {}
        above = [s for s, share in shares.items() if share > cap * sizes[s] * (1 + 1e-12)]
        if not above:
            return fixed | shares
        fixed |= {s: cap * sizes[s] for s in above}


def rows_of(seed: int, docs: int = 400):
    draw = random.Random(seed)
    # One source has half of all rows, one only empty texts, one is null.
    source = lambda: draw.choice(["hot"] * 5 + ["a", "b", "é", "Z", None])
    rows = [(n, " ".join(["w"] * draw.choice([0, 1, 3, 3, 3, 40, draw.randint(1, 300)])), source(), "clash", 1) for n in range(docs)]
    return rows + [(None, "a\tb c", "a", None, None), (5, None, "none", None, None), (5, None, "none", None, None), (5, "x y", "hot", None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_copies(spark, seed):
    rows = rows_of(seed)
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    sizes, largest, taken = {}, {}, {}
    for row in got:
        sizes[row.source] = sizes.get(row.source, 0) + row.size
        largest[row.source] = max(largest.get(row.source, 0), row.size)
        taken[row.source] = taken.get(row.source, 0) + row.taken
        assert 0 <= row.copies <= 2 and row.taken == row.copies * row.size
    want = targets(sizes)
    for row in got:
        assert row.source_size == sizes[row.source]
        assert row.target == pytest.approx(want[row.source])
    for source, share in want.items():
        assert abs(taken[source] - share) <= 4 * largest[source]
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()))


def test_empty_tables_and_texts(spark):
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    only = mixing.mix_sources(spark.createDataFrame([(1, "", "a", None, None), (2, None, None, None, None)], SCHEMA)).collect()
    assert {(row.size, row.target, row.taken) for row in only} == {(0, 0.0, 0)}


def test_emitted_rows_are_the_copies(spark):
    docs = spark.createDataFrame([(n, "w " * n, "a", str(n), n) for n in range(1, 30)], SCHEMA)
    mixed = mixing.mix_sources(docs)
    out = mixing.emitted(docs, mixed)
    assert out.columns == docs.columns
    assert out.count() == sum(row.copies for row in mixed.collect())
