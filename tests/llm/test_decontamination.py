from __future__ import annotations

import hashlib
import random
import re

import pytest

from logweir.llm import decontamination

DOCS, ITEMS = "doc_id long, text string, words string, item_id long", "item_id long, text string, length int"


def words(text: str | None) -> list[str]:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def judged(docs, items):
    """Every window against every position."""
    for number, text in docs:
        own, hit, found = words(text), set(), set()
        for item, item_text in items:
            theirs = words(item_text)
            size = min(13, len(theirs))
            for start in range(len(theirs) - size + 1) if size else []:
                window = theirs[start : start + size]
                for at in range(len(own) - size + 1):
                    if own[at : at + size] == window:
                        hit.update(range(at, at + size))
                        if item is not None:
                            found.add(str(item))
        ids = ",".join(sorted(found))
        yield number, len(own), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)


@pytest.mark.parametrize("seed", range(3))
def test_same_as_every_window_against_every_position(spark, seed):
    draw = random.Random(seed)
    vocabulary = ["Ab", "aB", "é", "É", "c3", "Ünder", "I", "i"] if seed else [f"w{n}" for n in range(60)]
    text = lambda n: draw.choice([" ", ", ", "\n"]).join(draw.choice(vocabulary) for _ in range(n))
    items = [(n, text(draw.choice([0, 1, 2, 5, 12, 13, 14, 20, 30]))) for n in range(14)] + [(None, text(15)), (99, None), (3, text(13))]
    if not seed:
        items = [item for item in items if len(words(item[1])) >= 12]
    docs = []
    for n in range(60):
        parts = [text(draw.randint(0, 30))]
        for _ in range(draw.randint(0, 2)):
            theirs = (draw.choice(items)[1] or "").split()
            start = draw.randint(0, max(0, len(theirs) - 10))
            parts += [" ".join(theirs[start : start + draw.randint(5, 40)]).upper() if draw.random() < 0.3 else " ".join(theirs), text(draw.randint(0, 300))]
        docs.append((n % 50, " . ".join(parts)))
    docs += [(None, items[0][1]), (60, None), (61, ""), (61, "--"), (62, text(4000)), (62, text(10))]
    got = decontamination.digest(
        decontamination.contamination(
            spark.createDataFrame([(*row, "clash", 1) for row in docs], DOCS), spark.createDataFrame([(*row, 1) for row in items], ITEMS)
        )
    ).collect()
    key = lambda row: repr(tuple(row))
    assert sorted(map(key, got)) == sorted(map(key, judged(docs, items)))


def test_empty_tables(spark):
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b c", None, None)], DOCS)
    assert decontamination.contamination(no_docs, no_items).collect() == []
    got = decontamination.contamination(some, no_items).collect()
    assert [(row.n_words, row.n_hit, row.contaminated) for row in got] == [(3, 0, False)]
