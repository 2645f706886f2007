"""Each stage against brute force over what its predecessor kept."""

from __future__ import annotations

import random

import corpus_pipeline
from logweir.llm import repeats
from tests.llm.test_decontamination import judged
from tests.llm.test_mixing import targets
from tests.llm.test_simhash import classes, plain_fingerprint


def documents() -> list[tuple]:
    draw = random.Random(4)
    vocabulary = {"en": ["the", "and", "house", "with", "there", "thing"], "de": ["der", "und", "häuser", "mit", "schön", "ding"]}
    rows = []
    for n in range(80):
        lang = draw.choice(["en", "de"])
        rows.append((n, " ".join(draw.choice(vocabulary[lang]) + draw.choice(["", "s", "x", "y"]) for _ in range(draw.randint(20, 90))), lang, draw.choice(["s1", "s2", None]), 0.5))
    rows += [(100 + n, rows[n][1] + " extra", rows[n][2], "s1", None) for n in range(10)]
    rows += [(120, rows[3][1], "en", "s2", None), (121, None, None, None, None), (122, "12 34", "en", "s1", None), (123, "", "de", "s1", None), (5, *rows[5][1:])]
    items = [" ".join(draw.choice(vocabulary["en"]) + draw.choice(["q", "z", "w"]) for _ in range(20)) for _ in range(3)]
    rows += [(200 + n, f"{item} and the house with things", "en", "s2", None) for n, item in enumerate(items)]
    return rows, items


def test_stages(spark, tmp_path):
    rows, items = documents()
    docs = spark.createDataFrame([(n, text, lang, source, len(text or ""), score) for n, text, lang, source, score in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder, stage = str(tmp_path), dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash", "suffix_repeats", "decontamination", "mixing"]

    known = stage["language_id"](spark, docs, folder)
    assert known.columns == docs.columns
    left = [row for row in rows if any(c.isalpha() for c in row[1] or "")]
    assert sorted(row.doc_id for row in known.collect()) == sorted(row[0] for row in left)

    alone = stage["simhash"](spark, known, folder)
    label, first = classes([plain_fingerprint(row[1]) for row in left]), {}
    for row, own in zip(left, label):
        first[own] = min(row[0], first.get(own, row[0]))
    assert alone.columns == docs.columns
    assert sorted(row.doc_id for row in alone.collect()) == sorted(first.values())

    texts = {row.doc_id: row.text for row in alone.collect()}
    ids = sorted(texts)
    cut = dict(zip(ids, repeats.naive(ids, [texts[n].encode() for n in ids])))
    shorter = stage["suffix_repeats"](spark, alone, folder)
    kept = {row.doc_id: row for row in shorter.collect()}
    assert shorter.columns == docs.columns
    assert set(kept) == {n for n in ids if not cut[n][0] or cut[n][1] < cut[n][0]}
    for n, row in kept.items():
        assert cut[n][1] == 0 and row.text == texts[n] or len(row.text.encode()) <= cut[n][0] - cut[n][1]
        assert row.n_chars == len(row.text)

    clean = stage["decontamination"](spark, shorter, folder)
    tainted = {row[0] for row in judged([(n, row.text) for n, row in kept.items()], list(enumerate(items))) if row[-1]}
    assert tainted and clean.columns == docs.columns
    assert {row.doc_id for row in clean.collect()} == set(kept) - tainted

    mixed = stage["mixing"](spark, clean, folder).collect()
    sizes = {}
    for row in mixed:
        sizes[row.source] = sizes.get(row.source, 0) + row.size
    assert {row.source: round(row.target, 6) for row in mixed} == {source: round(value, 6) for source, value in targets(sizes).items()}
    assert sorted(map(repr, corpus_pipeline.run(spark, folder).collect())) == sorted(map(repr, mixed))
