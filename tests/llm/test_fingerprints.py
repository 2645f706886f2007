from __future__ import annotations

import hashlib
import random
import re

import pytest

from logweir.llm import fingerprints

SCHEMA = "doc_id long, text string, own string, n_chars string"


def units(text: str) -> set[str]:
    return {part.strip(" ") for part in re.findall(r"[^\n]{96}\S*|[^\n]+", text) if part.strip(" ")}


def likeness(a: str, b: str) -> float:
    both = units(a) | units(b)
    return len(units(a) & units(b)) / len(both) if both else 1.0


def texts(seed: int) -> list[tuple[int | None, str | None]]:
    draw = random.Random(seed)
    line = lambda: " ".join(draw.choice(["alpha", "beta", "gamma", "dë", "x"]) for _ in range(draw.randint(0, 30)))
    rows: list[tuple[int | None, str | None]] = [(n * 3, "\n".join(line() for _ in range(draw.choice([0, 1, 2, 20, 60])))) for n in range(40)]
    rows += [(121, rows[20][1]), (122, rows[20][1]), (200, ""), (201, None), (202, "ab"), (203, "é"), (500, "\n".join(line() for _ in range(900)))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_sets_of_paragraphs(spark, seed):
    rows = texts(seed)
    got = {row.doc_id: row for row in fingerprints.version_fingerprints(spark.createDataFrame([(*row, "clash", "") for row in rows], SCHEMA)).collect()}
    assert len(got) == len(rows)
    order = sorted(((n, text or "") for n, text in rows), reverse=True)
    for place, (number, text) in enumerate(order):
        following = order[(place + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        row = got[number]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.near_edited == pytest.approx(likeness(text, edited))
        assert row.near_next == pytest.approx(likeness(text, following))
    by_text = {}
    for number, text in order:
        assert by_text.setdefault(text, got[number].fingerprint) == got[number].fingerprint


def test_peeling_recovers_the_digests(spark):
    rows = texts(3)
    stored, results = fingerprints.compared(spark.createDataFrame([(*row, "", "") for row in rows], SCHEMA), with_digests=True)
    sets = {row["_number"]: (set(row.own), set(row.edited), set(row.next)) for row in stored.collect()}
    seen = {(row["_number"], row.pair): row for row in results.collect()}
    for number, (own, edited, following) in sets.items():
        for pair, other in ((0, edited), (1, following)):
            row = seen.get((number, pair))
            assert (set(row.gone) if row else set()) == own - other
            assert (set(row.new) if row else set()) == other - own


def test_repeated_rows_null_ids_and_small_tables(spark):
    rows = [(7, "a\nb\nc", "", ""), (7, "a\nb\nc", "", ""), (7, "other", "", ""), (None, "x\ny", "", "")]
    got = fingerprints.version_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(row.doc_id) for row in got) == ["7", "7", "7", "None"]
    one = fingerprints.version_fingerprints(spark.createDataFrame(rows[:1], SCHEMA)).collect()
    assert [(row.n_chars, row.near_next) for row in one] == [(5, 1.0)]
    assert fingerprints.version_fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []


def test_more_buckets_asked_for_than_spark_allows(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 2)
    old = spark.conf.get("spark.sql.sources.bucketing.maxBuckets")
    rows = [(n, f"line {n}\nshared\nline {n // 2}", "", "") for n in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, fingerprints.version_fingerprints(docs).collect()))
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "3")
    try:
        assert sorted(map(tuple, fingerprints.version_fingerprints(docs).collect())) == want
    finally:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", old)
