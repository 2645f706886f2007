from __future__ import annotations

import random
import re
import textwrap
from difflib import SequenceMatcher

import pytest

from logweir.llm import licenses

SCHEMA = "doc_id long, text string, license string, block int"
HINT = re.compile(licenses.HINT)
PROSE = "the harbour was quiet that morning and nobody on the quay had seen the boats come in from the long night at sea "


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.TEMPLATES)


def found_in(scanner, text):
    return [result for _, block in licenses.blocks(text, HINT, scanner.known) for result in scanner.scan(block, HINT)]


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_wording_is_found_in_its_own_words(scanner, name):
    for text in licenses.TEMPLATES[name]:
        (found,) = found_in(scanner, text)
        assert found["license"] == name and found["confirmed"] and found["differences"] == []


@pytest.mark.parametrize("name", ["MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-3.0", "LGPL-3.0", "Zlib", "Unlicense"])
@pytest.mark.parametrize("layout", ["wrapped", "one line", "comment", "in prose"])
def test_whole_licenses_in_any_layout(scanner, name, layout):
    text = licenses.WORDINGS[name].replace("Copyright (c).", "Copyright (c) 2021 Ada Example and others\n\n")
    if layout == "wrapped":
        text = "\n\n".join(textwrap.fill(part, 70) for part in text.split("\n\n"))
    elif layout == "comment":
        text = "\n".join(f" * {line}" for line in textwrap.wrap(text, 60))
    elif layout == "in prose":
        text = f"{PROSE * 3}.\n{text}\n{PROSE * 3}."
    confirmed = [found for found in found_in(scanner, text) if found["confirmed"]]
    assert [found["license"] for found in confirmed] == [name]
    assert confirmed[0]["n_same"] >= 0.9 * len(licenses.WORD.findall(licenses.WORDINGS[name]))


def test_exact_differences(scanner):
    (found,) = found_in(scanner, "Licensed under the Apache License, Version 3.0.")
    assert found["license"] == "Apache-2.0" and found["confirmed"] and found["differences"] == ["-2.0", "+3.0"]
    changed = licenses.WORDINGS["MIT"].replace("sublicense", "relicense")
    (found,) = found_in(scanner, changed)
    assert found["license"] == "MIT" and found["differences"] == ["-sublicense", "+relicense"]
    assert not any(result["confirmed"] for result in found_in(scanner, "I lost my driver licence on the way home, nobody has found it."))
    assert not any(result["confirmed"] for result in found_in(scanner, "Licensed under the Foo License. All rights reserved by the permission of Bar."))


def test_neighbouring_licenses_are_told_apart(scanner):
    text = "# SPDX-License-Identifier: Apache-2.0\nReleased under the MIT License.\n" + licenses.WORDINGS["BSD-3-Clause"]
    assert [found["license"] for found in found_in(scanner, text) if found["confirmed"]] == ["Apache-2.0", "MIT", "BSD-3-Clause"]


def test_long_blocks_go_on(scanner):
    text = (licenses.WORDINGS["MIT"] + "\n") * 12
    found = found_in(scanner, text)
    assert {result["license"] for result in found if result["confirmed"]} == {"MIT"} and all(result["n_words"] <= licenses.LONGEST for result in found)
    assert sum(result["n_words"] for result in found) == 12 * len(licenses.WORD.findall(licenses.WORDINGS["MIT"]))
    words = "licensed " * 3000
    assert sum(len(block.split()) for _, block in licenses.blocks(words, HINT, scanner.known)) == 3000


def brute(block: str) -> tuple[set[str], int]:
    """Licenses with the fewest words to add or leave out, by aligning the block with every wording; no sizes, no ranks."""
    own, costs = [word.lower() for word in licenses.WORD.findall(block)], {}
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            theirs = licenses.WORD.findall(text.lower())
            same = sum(match.size for match in SequenceMatcher(None, theirs, own, autojunk=False).get_matching_blocks())
            costs[name] = min(costs.get(name, 10**9), len(own) + len(theirs) - 2 * same)
    least = min(costs.values())
    return {name for name, cost in costs.items() if cost == least}, least


def test_compression_finds_what_aligning_with_every_wording_finds(scanner):
    draw = random.Random(3)
    for name, text in sorted(licenses.WORDINGS.items()):
        for _ in range(6):
            words = [word for word in text.split() if draw.random() > 0.04]
            for _ in range(3):
                words.insert(draw.randint(0, len(words)), draw.choice(["harbour", "boats", "quay"]))
            found = scanner.judged(" ".join(words))
            names, least = brute(" ".join(words))
            assert found["license"] in names and found["license"] == name and found["confirmed"]
            assert len(found["differences"]) == least


def test_blocks_and_rows(spark):
    rows = [
        (1, "Some prose.\nReleased under the\n\nMIT License.\nmore prose", None, None),
        (2, "Prose " * 100 + "ends here. Licensed under CC BY-NC 4.0. And it goes on. " + "prose " * 50, None, None),
        (3, None, None, None), (4, "", "x", 1), (None, "Copyright 2020 Somebody", None, None), (5, "no such words", None, None),
        (6, "Licensed under CC BY 4.0.", None, None), (6, "Licensed under CC BY 4.0.", None, None),
    ]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    by_id = {}
    for row in got:
        by_id.setdefault(row.doc_id, []).append(row)
    assert [row.license for row in by_id[2]] == ["CC-BY-NC-4.0"] and by_id[2][0].confirmed
    assert [row.license for row in by_id[6]] == ["CC-BY-4.0"] * 2
    assert not by_id[None][0].confirmed
    assert {3, 4, 5}.isdisjoint(by_id)
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []
