from __future__ import annotations

import random

import pytest

from logweir.llm import repeats

SCHEMA = "doc_id long, text string, kept string, n_chars long, _id int"


def rows_of(seed: int):
    draw = random.Random(seed)
    passages = ["".join(draw.choice("ab") for _ in range(draw.randint(40, 200))) for _ in range(6)]
    rows = []
    for _ in range(200):
        text = ""
        for _ in range(draw.randint(0, 5)):
            text += draw.choice(passages)[draw.randint(0, 20) : draw.randint(30, 200)] + "".join(draw.choice("abcé ") for _ in range(draw.randint(0, 60)))
        rows.append((draw.randint(0, 150), text))
    # A third of all rows is one text; runs of one letter match themselves at every shift.
    rows += [(n, passages[0] + "common tail of many documents " * 4) for n in range(300, 400)]
    return rows + [(7, "x" * 300), (9, "x" * 49), (10, "x" * 50), (11, "x" * 500), (12, ""), (13, None), (None, "x" * 120), (-5, "abc" * 40)]


@pytest.mark.parametrize("seed, block, entries", [(1, 4_000, 200), (2, 1 << 20, 1 << 20)])
def test_same_as_every_window(spark, monkeypatch, seed, block, entries):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    monkeypatch.setattr(repeats, "BUCKET_ENTRIES", entries)
    rows = rows_of(seed)
    got = repeats.repeated_bytes(spark.createDataFrame([(*row, "clash", 0, 1) for row in rows], SCHEMA)).collect()
    ids = [repeats.LAST_ID if n is None else n for n, _ in rows]
    want = [(n, *row) for n, row in zip(ids, repeats.naive(ids, [(text or "").encode() for _, text in rows]))]
    assert sorted((repeats.LAST_ID if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got) == sorted(want)


def test_remaining_documents_keep_their_columns(spark):
    passage = "a passage that two documents have word for word, and long enough for the width; "
    rows = [(1, passage + "first ä", "k", 87, 1), (2, "second é " + passage, "k", 89, 2), (3, passage, "k", 80, 3), (4, None, "k", None, 4), (5, "", None, 0, 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = repeats.without_repeats(docs)
    assert left.columns == docs.columns and left.dtypes == docs.dtypes
    got = {row.doc_id: row for row in left.collect()}
    assert sorted(got) == [1, 2, 4, 5]
    assert got[1].text == rows[0][1] and got[1]["_id"] == 1
    assert got[2].text == "second é" and got[2].n_chars == 8 or got[2].text == "second é " and got[2].n_chars == 9
    assert got[4].text is None and got[5].text == ""


def test_empty_table(spark):
    assert repeats.repeated_bytes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_more_blocks_than_buckets_and_many_rows_without_an_id(spark, monkeypatch):
    """Blocks beyond Spark's bound on buckets share them; rows of one id are spread over blocks."""
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 1_500)
    monkeypatch.setattr(repeats, "BUCKET_ENTRIES", 100)
    old = spark.conf.get("spark.sql.sources.bucketing.maxBuckets")
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "5")
    try:
        rows = [(n % 90 if n % 3 else None, f"{n} " + "one passage that is long enough to be found again and again; " + f"end {n % 7}" * (n % 5)) for n in range(270)]
        docs = spark.createDataFrame([(*row, "clash", 0, 1) for row in rows], SCHEMA)
        blocks = spark.table(repeats._stored(docs, "doc_id", "text", ())[0]).where("_id is null").select("_block").distinct().count()
        assert blocks > 10
        got = repeats.repeated_bytes(docs).collect()
    finally:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", old)
    ids = [repeats.LAST_ID if n is None else n for n, _ in rows]
    want = [(n, *row) for n, row in zip(ids, repeats.naive(ids, [text.encode() for _, text in rows]))]
    assert sorted((repeats.LAST_ID if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got) == sorted(want)
