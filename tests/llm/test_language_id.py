from __future__ import annotations

import os
import zlib

import numpy as np
import pytest

from logweir.llm import language_id

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score double, lang_pred string"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables not found")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {row.doc_id: row.lang for row in docs.select("doc_id", "lang").collect()}
    got = language_id.identify(docs).collect()
    assert len(got) == docs.count()
    held = [row for row in got if row.held_out]
    assert {row.doc_id for row in held} == {n for n in labels if zlib.crc32(str(n).encode()) % 3 == 1}
    assert sum(row.lang_pred == labels[row.doc_id] for row in held) >= 0.97 * len(held)
    assert all(0 <= row.score <= 1 for row in got)


def test_bound_vectors_follow_the_definition():
    keys, counts = language_id.trigrams("Ab,  ab")
    letters = {c: language_id.letter_vectors(np.array([ord(c)]))[0].astype(int) for c in " ab"}
    want = 0
    for gram in (" ab", "ab ", "b a", " ab", "ab "):
        want = want + np.roll(letters[gram[0]], 2) * np.roll(letters[gram[1]], 1) * letters[gram[2]]
    assert (counts @ language_id.trigram_vectors(keys).astype(int) == want).all()
    assert np.allclose(language_id.text_vectors(["Ab,  ab"])[0], want / np.linalg.norm(want), atol=1e-6)


def test_long_texts_in_blocks_are_counted_whole(monkeypatch):
    text = "Ein Satz, der sich wiederholt und viele Wörter hat; noch einer. " * 40
    whole = language_id.trigrams(text)
    monkeypatch.setattr(language_id, "BLOCK", 97)
    parts = language_id.trigrams(text)
    assert abs(int(whole[1].sum()) - int(parts[1].sum())) <= len(text) // 97


def test_nulls_and_texts_without_letters(spark):
    rows = [(n, "the cat and the dog were here" if n % 2 else "le chat et le chien sont ici", "en" if n % 2 else "fr", 1.0, "x") for n in range(60)]
    rows += [(100, None, "en", None, None), (101, "", None, None, None), (102, "12 34 !?", "fr", None, None), (None, "the dog", None, None, None), (100, None, "en", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    for row in got:
        if row.doc_id is not None and row.doc_id >= 100:
            assert (row.lang_pred, row.score) == ("und", 0.0)
        elif row.doc_id is None:
            assert row.lang_pred == "en" and not row.held_out
        else:
            assert row.lang_pred == ("en" if row.doc_id % 2 else "fr")
    kept = language_id.with_language(docs, language_id.learn(docs))
    assert sorted(kept.columns) == sorted(docs.columns)


def test_nothing_to_learn_from(spark):
    assert language_id.identify(spark.createDataFrame([], SCHEMA)).collect() == []
    got = language_id.identify(spark.createDataFrame([(1, "text", None, None, None)], SCHEMA)).collect()
    assert [row.lang_pred for row in got] == ["und"]
