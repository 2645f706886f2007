from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from logweir.llm import simhash
from logweir.llm.links import components

SCHEMA = "doc_id long, text string, fp string, tile int"


def plain_fingerprint(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def classes(fps: list[int], radius: int = 2) -> list[int]:
    label, changed = list(range(len(fps))), True
    near = [[j for j, other in enumerate(fps) if (fp ^ other).bit_count() <= radius] for fp in fps]
    while changed:
        new = [min(label[j] for j in row) for row in near]
        changed, label = new != label, new
    return label


def texts(seed: int) -> list[str | None]:
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcé") for _ in range(draw.randint(1, 5)))
    found: list[str | None] = [None, "", " \t\n", "one", "one two", "ONE two", "É x y z", "é x y z"]
    for _ in range(60):
        words = [word() for _ in range(draw.randint(1, 200))]
        found.append(" ".join(words))
        for _ in range(draw.randint(0, 6)):
            copy = list(words)
            copy[draw.randrange(len(copy))] = word()
            found.append("\n ".join(copy))
    return found


@pytest.mark.parametrize("tile", [4096, 3])
def test_components_are_those_of_all_pairs(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    some = texts(tile)
    rows = [(1000 - n, text, "clash", n) for n, text in enumerate(some)] + [(4000, some[9], None, None), (4000, some[9], None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    fps = [plain_fingerprint(row[1]) for row in rows]
    label, least = classes(fps), {}
    for row, own in zip(rows, label):
        least[own] = min(row[0], least.get(own, row[0]))
    want = sorted((row[0], format(fp, "016x"), least[own]) for row, fp, own in zip(rows, fps, label))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_tiles_meet_whatever_is_within_the_radius():
    draw = np.random.default_rng(1)
    moves = {tuple(step) for step in simhash.steps(2).tolist()}
    assert len(moves) == 73
    for _ in range(300):
        one = draw.integers(0, 1 << 63, dtype=np.int64)
        two = one ^ np.int64(1 << int(draw.integers(0, 63))) ^ np.int64(1 << int(draw.integers(0, 63)))
        change = tuple((simhash.byte_counts(np.array([two])) - simhash.byte_counts(np.array([one])))[0].tolist())
        assert change in moves or tuple(-x for x in change) in moves


def test_chains_and_empty_tables(spark):
    chain = [(n, n + 1) for n in range(50)] + [(100, 101), (None, 3), (7, 7), (200, None)]
    got = {row.id: row.root for row in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(51)} | {100: 100, 101: 100}
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    only = simhash.near_duplicates(spark.createDataFrame([(None, "a b c", None, None)], SCHEMA)).collect()
    assert [row.component_id for row in only] == [None]
