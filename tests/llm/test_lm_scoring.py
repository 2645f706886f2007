from __future__ import annotations

import math
import os
import random
import types
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.llm import lm_scoring
from logweir.llm.lm_scoring import GROUPS, VOCABULARY, Network

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, mean double, part int"


def test_gradients_are_those_of_the_loss():
    network = Network.start(3)
    network.parts = {name: part.astype(np.float64) for name, part in network.parts.items()}
    draw = np.random.default_rng(0)
    words, around = draw.integers(0, VOCABULARY, 6), draw.integers(0, VOCABULARY + 1, (4, 6))
    gradients = network.gradients(words, around)
    for name, part in network.parts.items():
        for _ in range(4):
            at = tuple(int(draw.integers(0, size)) for size in part.shape)
            at = (at[0], int(around[at[0]][0]), at[2]) if name == "near" else at
            part[at] += 1e-5
            up = -network.log_probabilities(words, around).mean()
            part[at] -= 2e-5
            down = -network.log_probabilities(words, around).mean()
            part[at] += 1e-5
            assert (up - down) / 2e-5 == pytest.approx(gradients[name][at], abs=1e-6)


def test_probabilities_sum_to_one():
    network = Network.start(5)
    around = np.repeat(np.array([[3], [900], [5], [VOCABULARY]]), VOCABULARY, axis=1)
    total = np.exp(network.log_probabilities(np.arange(VOCABULARY), around)).sum()
    assert total == pytest.approx(1, abs=1e-4) and GROUPS * GROUPS == VOCABULARY


def test_scores_are_sums_over_both_sides(spark):
    rows = [(1, "The cat saw the dog", None, 1), (2, None, 0.5, None), (3, " .. ", None, None), (None, "dog", None, None), (1, "The cat saw the dog", None, 1), (4, "the cat " * 3000, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = lm_scoring.vocabulary(docs)
    assert known["the"] < known["saw"]
    network = lm_scoring.train(docs, known)
    got = lm_scoring.score(docs, network, known).collect()
    rounded = lambda rows: sorted((str(row.doc_id), row.n_words, round(row.log_likelihood, 2)) for row in rows)
    assert rounded(got) == rounded(lm_scoring.score(docs.repartition(3), network, known).collect())
    for row, (_, text, *_rest) in zip(got, rows):
        own = lm_scoring.classes(text, known)
        padded = [VOCABULARY] * 2 + own + [VOCABULARY] * 2
        want = sum(
            float(network.log_probabilities(np.array([padded[k]]), np.array([[padded[k - 2]], [padded[k - 1]], [padded[k + 1]], [padded[k + 2]]]))[0])
            for k in range(2, len(padded) - 2)
        )
        assert row.n_words == len(own)
        assert row.log_likelihood == pytest.approx(want, rel=1e-4, abs=1e-4)
        assert (row["mean"] is None) == (not own)
    assert lm_scoring.pseudo_likelihood(docs.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables not found")
def test_prose_scores_above_shuffled_prose(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars > 400")
    known = lm_scoring.vocabulary(docs)
    network = lm_scoring.train(docs, known, rounds=2)
    draw = random.Random(1)
    mixed = [(row.doc_id, " ".join(draw.sample(row.text.split(), len(row.text.split())))) for row in docs.select("doc_id", "text").collect()]
    total = lambda df: df.agg(F.sum("log_likelihood") / F.sum("n_words")).first()[0]
    own = total(lm_scoring.score(docs, network, known))
    other = total(lm_scoring.score(spark.createDataFrame(mixed, "doc_id long, text string"), network, known))
    assert own > other and own > -np.log(VOCABULARY)


@pytest.mark.parametrize("listed", [0, 40, 1 << 16])
def test_every_word_has_its_share_of_a_shared_class(spark, monkeypatch, listed):
    draw = random.Random(7)
    monkeypatch.setattr(lm_scoring, "LISTED", listed)
    common = [f"often{n}" for n in range(VOCABULARY)]
    rare = {f"rare{n}": draw.choice([1, 1, 2, 3, 7]) for n in range(300)}
    words = common * 9 + [word for word, n in rare.items() for _ in range(n)]
    draw.shuffle(words)
    texts = [" ".join(words[at : at + 50]) for at in range(0, len(words), 50)]
    rows = [(n % 90 if n % 7 else None, text) for n, text in enumerate([*texts, texts[0], "", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = lm_scoring.vocabulary(docs)
    plain = lm_scoring.score(docs, lm_scoring.train(docs, known), known).collect()
    counts = Counter(word for _, text in rows for word in (text or "").split())
    totals = Counter()
    for word, n in counts.items():
        totals[lm_scoring.shared_class(word)] += 0 if word in known else n
    want = []
    for row, (_, text) in zip(plain, rows):
        shares = [math.log(counts[word] / totals[lm_scoring.shared_class(word)]) for word in (text or "").split() if word not in known]
        want.append((str(row.doc_id), row.n_words, round(row.log_likelihood + sum(shares), 3)))
    assert any(counts[word] > 1 for word in counts if word not in known)
    got = [(str(row.doc_id), row.n_words, round(row.log_likelihood, 3)) for row in lm_scoring.pseudo_likelihood(docs).collect()]
    for one, other in zip(sorted(got), sorted(want)):
        assert one[:2] == other[:2] and one[2] == pytest.approx(other[2], abs=0.01)
    assert len(got) == len(want)


def test_more_words_have_more_classes():
    assert lm_scoring.groups_for(1000) == lm_scoring.groups_for(1 << 16) == GROUPS < lm_scoring.groups_for(1 << 20) < lm_scoring.groups_for(1 << 26)
    larger = Network.start(groups=lm_scoring.groups_for(1 << 20))
    again = Network.of(larger.flat(), larger.groups)
    around = np.repeat(np.array([[3], [900], [5], [larger.groups**2]]), larger.groups**2, axis=1)
    assert np.exp(again.log_probabilities(np.arange(larger.groups**2), around)).sum() == pytest.approx(1, abs=1e-4)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables not found")
@pytest.mark.parametrize("parts", [2, 100])
def test_one_round_fits_however_the_input_is_split(spark, parts):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars > 400")
    known = lm_scoring.vocabulary(docs)
    network = lm_scoring.train(docs.repartition(parts), known)
    draw = random.Random(1)
    rows = docs.select("doc_id", "text").collect()
    mixed = [(row.doc_id, " ".join(draw.sample(row.text.split(), len(row.text.split())))) for row in rows]
    total = lambda df: df.agg(F.sum("log_likelihood") / F.sum("n_words")).first()[0]
    own = total(lm_scoring.score(docs, network, known))
    other = total(lm_scoring.score(spark.createDataFrame(mixed, "doc_id long, text string"), network, known))
    counts = np.array(list(Counter(n for row in rows for n in lm_scoring.classes(row.text, known)).values()))
    # What the classes' own frequencies give.
    alone = (counts * np.log(counts / counts.sum())).sum() / counts.sum()
    assert own > other + 0.05 and own > alone - 0.15


def test_each_different_word_is_looked_up_once(monkeypatch):
    looked_up = []
    monkeypatch.setattr(lm_scoring, "zlib", types.SimpleNamespace(crc32=lambda data: looked_up.append(data) or zlib.crc32(data)))
    list(lm_scoring.windows(iter(["the rare Rare word " * 500, None, "the word"]), lm_scoring.Vocabulary({"the": 0})))
    assert len(looked_up) == len(set(looked_up)) <= 3


@pytest.mark.parametrize("gathered", [1, 40, 1 << 21])
def test_words_are_those_of_the_pattern(monkeypatch, gathered):
    monkeypatch.setattr(lm_scoring, "GATHERED", gathered)
    monkeypatch.setattr(lm_scoring, "BATCH", 5)
    symbols = "".join(chr(n) for n in range(0x2190, 0x2190 + 2 * lm_scoring.FEW_CHARACTERS))
    texts = [None, "", " .. ", "a_b A-b", "The \u0130stanbul caf\u00e9 x\u00b2 \u4e2d\u6587\u3002\u5b57", f"one{symbols}two \u2028 three_", "\t\x1cthe\x00the\n" * 9, "e\u0301t\u00e9 " * 7, "last"]
    known = lm_scoring.Vocabulary({"the": 0, "b": 1, "two": 2})
    numbers, around = [], []
    for text in texts:
        own = [known[word] if word in known else VOCABULARY - lm_scoring.SHARED + lm_scoring.shared_class(word) for word in lm_scoring.WORD.findall((text or "").lower())]
        padded = [VOCABULARY] * 2 + own + [VOCABULARY] * 2
        numbers.append(own)
        around += [[padded[k - 2], padded[k - 1], padded[k + 1], padded[k + 2]] for k in range(2, len(padded) - 2)]
    found = list(lm_scoring.windows(iter(texts), known))
    assert [size for some in found for size in some.sizes] == [len(own) for own in numbers]
    batches = list(lm_scoring.gathered(iter(found)))
    assert [n for words, _ in batches for n in words] == sum(numbers, [])
    assert [row for _, some in batches for row in some.T.tolist()] == around
    assert all(len(words) >= 5 for words, _ in batches[:-1])


def test_gradients_are_the_same_in_parts(monkeypatch):
    network, draw = Network.start(3), np.random.default_rng(0)
    words, around = draw.integers(0, VOCABULARY, 500), draw.integers(0, VOCABULARY + 1, (4, 500))
    whole = network.gradients(words, around)
    monkeypatch.setattr(lm_scoring, "PART", 64)
    for name, gradient in network.gradients(words, around).items():
        np.testing.assert_allclose(gradient, whole[name], atol=1e-6)
