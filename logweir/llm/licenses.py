"""License scans by conditional compression.

A candidate block is compressed by itself and with the wordings of each license as a raw
dictionary; the licenses are ranked by the share of bytes they save. All that save nearly as
much as the first are then compared by exact wording: the block is aligned word by word with
each wording, and the words that differ are part of the result.

A block is a run of sentences, over lines and empty lines, that speak of a license or
whose pairs of words are mostly those of the wordings; one of them at least speaks of a license. An SPDX
line is a block of its own. Blocks end after ``LONGEST`` words and go on as a new one, so that nothing is left out.
A license is confirmed by the part of the block that its wording covers; what stands before and after it is
judged again as a block where it speaks of a license. Texts without such words never reach Python.

Nulls and texts without a candidate give no row; null ids are passed on. Repeated rows
give their blocks again. Ties between licenses go to the larger saving, then to the first by name. Texts are read
whole; other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of licenses as they stand in SPDX lines.
SPDX = {
    "AGPL-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"), "Apache-2.0": ("Apache-2.0",), "BSD-2-Clause": ("BSD-2-Clause",),
    "BSD-3-Clause": ("BSD-3-Clause",), "BSL-1.0": ("BSL-1.0",), "CC-BY-4.0": ("CC-BY-4.0",), "CC-BY-NC-4.0": ("CC-BY-NC-4.0",),
    "CC-BY-SA-4.0": ("CC-BY-SA-4.0",), "CC0-1.0": ("CC0-1.0",), "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"),
    "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"), "ISC": ("ISC",), "LGPL-3.0": ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "MIT": ("MIT",), "MPL-2.0": ("MPL-2.0",), "Unlicense": ("Unlicense",), "Zlib": ("Zlib",),
}
#: Short notices by name.
NOTICES = {
    "AGPL-3.0": ("This program is licensed under the GNU Affero General Public License, version 3.",),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.",),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "ISC": ("Released under the ISC License.",),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License."),
    "Zlib": ("Released under the zlib License.",),
}
#: The license in full where it is short, else the header it asks for in each file.
WORDINGS = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": 'BSD 2-Clause License. Copyright (c). All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'BSD 3-Clause License. Copyright (c). All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSL-1.0": 'Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "ISC": 'ISC License. Copyright (c). Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "MIT": 'MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def wordings(name: str) -> tuple[str, ...]:
    """All wordings of one license: its SPDX lines, short notices and the text itself."""
    lines = [f"SPDX-License-Identifier: {spdx}" for spdx in SPDX[name]]
    return (*lines, *NOTICES.get(name, ()), *([WORDINGS[name]] if name in WORDINGS else []))


TEMPLATES = {name: wordings(name) for name in SPDX}
#: Words that make a line a candidate; a line holds one of them. Java and Python read this pattern alike.
HINT = r"(?i)licen[cs]|copyright|spdx|creative commons|public domain|permission (?:is|to) |redistribut|free software|\bCC[ -]?(?:BY|0)\b"
LEVEL = 19
#: Licenses whose saving is within this of the best are compared by their wording.
MARGIN = 0.1
#: Share of the words of the covered part, and of a short wording, that have to be the wording's.
SAME = 0.8
#: So many words of a longer wording confirm it.
ENOUGH = 12
#: Words in a row that anchor the covered part.
ANCHOR = 3
#: Share of pairs of words known from the wordings with which a block goes on.
GOES_ON = 0.5
#: Words of a block at most, over twice those of the longest wording; a longer one goes on as a new block.
LONGEST = 600
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
SENTENCE = re.compile(r"(?<=[.!?:;])\s+")
SPDX_LINE = re.compile(r"(?i)SPDX-License-Identifier:\s*[\w.\-]+")


def sentences(text: str) -> Iterator[tuple[int, str]]:
    """Sentences of at most ``LONGEST`` words with the number of their line; SPDX lines by themselves."""
    for number, line in enumerate(text.split("\n")):
        at = 0
        for found in [*SPDX_LINE.finditer(line), None]:
            for part in SENTENCE.split(line[at : found.start() if found else len(line)]):
                words = part.split()
                for first in range(0, len(words), LONGEST):
                    yield number, " ".join(words[first : first + LONGEST])
            if found:
                yield number, found.group()
                at = found.end()


def blocks(text: str, hint: re.Pattern[str], known: frozenset[tuple[str, str]]) -> Iterator[tuple[int, str]]:
    """Candidate blocks of a text, each with the number of its first line."""
    found, first, size, last, spoken = [], 0, 0, "", False
    for number, part in sentences(text):
        own = WORD.findall(part.lower())
        if not own:
            continue
        alone, speaks = SPDX_LINE.fullmatch(part), bool(hint.search(part))
        pairs = list(zip([last, *own] if found else own, own if found else own[1:]))
        known_part = len(pairs) >= (1 if found else ANCHOR) and sum(pair in known for pair in pairs) >= GOES_ON * len(pairs)
        full = size + len(own) > LONGEST
        if found and (alone or full or not (speaks or known_part)):
            if spoken:
                yield first, " ".join(found)
            # What goes on after a full block needs no hint of its own.
            found, size, spoken = [], 0, spoken and full and known_part
        if alone:
            yield number, part
        elif speaks or known_part:
            first, spoken = first if found else number, spoken or speaks
            found.append(" ".join(part.split()))
            size, last = size + len(own), own[-1]
    if found and spoken:
        yield first, " ".join(found)


class Scanner:
    """Compressors and words of the licenses, made once a task."""

    def __init__(self, templates: Mapping[str, Sequence[str]]):
        self.words = {name: [WORD.findall(text.lower()) for text in texts] for name, texts in sorted(templates.items())}
        self.known = frozenset(pair for texts in self.words.values() for words in texts for pair in zip(words, words[1:]))
        kind = zstandard.DICT_TYPE_RAWCONTENT
        self.alone = self._compressor(None)
        self.with_license = {
            name: self._compressor(zstandard.ZstdCompressionDict("\n".join(templates[name]).encode(), dict_type=kind)) for name in self.words
        }

    @staticmethod
    def _compressor(dictionary) -> zstandard.ZstdCompressor:
        # Nothing but the coded block: sizes are compared, frames are not kept.
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False)

    def ranked(self, block: str) -> list[tuple[float, str]]:
        """Share of bytes that each license saves, best first."""
        data = block.encode("utf-8", "surrogatepass")
        size = len(self.alone.compress(data))
        saved = [(1 - len(compressor.compress(data)) / size, name) for name, compressor in self.with_license.items()]
        return sorted(saved, key=lambda entry: (-entry[0], entry[1]))

    def wording(self, own: list[str], theirs: list[str]) -> dict:
        """How a block's words follow one wording.

        ``same``: words in the same order; ``start, stop``: the part of the block that the wording covers,
        from the first to the last ``ANCHOR`` words in a row; ``differences``: ``-word`` for the wording's and ``+word`` for
        the block's, all of the block's and, unless the wording is there in good part, the wording's between matches only.
        """
        matches = [match for match in SequenceMatcher(None, theirs, own, autojunk=False).get_matching_blocks() if match.size]
        anchors = [match for match in matches if match.size >= min(ANCHOR, len(theirs))]
        same, differences = sum(match.size for match in matches), []
        start, stop = (anchors[0].b, anchors[-1].b + anchors[-1].size) if anchors else (0, 0)
        covered = sum(match.size for match in matches if start <= match.b < stop)
        whole = same >= SAME * len(theirs)
        for before, after in zip([None, *matches], [*matches, None]):
            if whole or (before and after):
                differences += [f"-{word}" for word in theirs[before.a + before.size if before else 0 : after.a if after else len(theirs)]]
            differences += [f"+{word}" for word in own[before.b + before.size if before else 0 : after.b if after else len(own)]]
        confirmed = bool(anchors) and covered >= SAME * (stop - start) and covered >= min(ENOUGH, SAME * len(theirs))
        return {"same": same, "start": start, "stop": stop, "differences": differences, "confirmed": confirmed}

    def judged(self, block: str) -> dict:
        """The license of a block: of all that save nearly as much as the best, confirmed ones first, the one with the fewest differing words."""
        order = self.ranked(block)
        own = [word.lower() for word in WORD.findall(block)]
        near = [name for saved, name in order if saved >= order[0][0] - MARGIN]
        aligned = [(self.wording(own, theirs), name) for name in near for theirs in self.words[name]]
        best, name = min(aligned, key=lambda entry: (not entry[0]["confirmed"], len(entry[0]["differences"]), near.index(entry[1])))
        saved = {other: share for share, other in order}
        return {
            "block": block, "license": name, "saved": saved[name], "runner_up": next((other for _, other in order if other != name), None),
            "n_words": len(own), "n_same": best["same"], "differences": best["differences"], "confirmed": best["confirmed"],
        } | {"start": best["start"], "stop": best["stop"]}

    def scan(self, block: str, hint: re.Pattern[str]) -> Iterator[dict]:
        """Results of a block in its order; one that holds several licenses is cut between them."""
        found = self.judged(block)
        start, stop = found.pop("start"), found.pop("stop")
        places = [(match.start(), match.end()) for match in WORD.finditer(block)]
        before, after = (block[: places[start][0]], block[places[stop - 1][1] :]) if found["confirmed"] else ("", "")
        rest = [part.strip() if len(WORD.findall(part)) > ANCHOR and hint.search(part) else "" for part in (before, after)]
        if not any(rest):
            yield found
            return
        if rest[0]:
            yield from self.scan(rest[0], hint)
        yield {key: value for key, value in self.judged(block[places[start][0] if rest[0] else 0 : places[stop - 1][1] if rest[1] else len(block)]).items() if key not in ("start", "stop")}
        if rest[1]:
            yield from self.scan(rest[1], hint)


def scan(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per candidate block: doc_id, line, block, license, saved, runner_up, n_words, n_same, differences, confirmed."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(HINT))
    fields = "line int, block string, license string, saved double, runner_up string, n_words int, n_same int, differences array<string>, confirmed boolean"
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {fields}"
    templates = dict(templates)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, hint = Scanner(templates), re.compile(HINT)
        kinds = pa.schema(
            [
                ("line", pa.int32()), ("block", pa.string()), ("license", pa.string()), ("saved", pa.float64()), ("runner_up", pa.string()),
                ("n_words", pa.int32()), ("n_same", pa.int32()), ("differences", pa.list_(pa.string())), ("confirmed", pa.bool_()),
            ]
        )
        for batch in batches:
            owners, found = [], []
            for row, text in enumerate(batch.column(1)):
                for line, block in blocks(text.as_py(), hint, scanner.known):
                    results = [{"line": line} | result for result in scanner.scan(block, hint)]
                    owners += [row] * len(results)
                    found += results
            part = pa.RecordBatch.from_pylist(found, schema=kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *part.columns], names=["doc_id", *kinds.names])

    return rows.mapInArrow(scanned, schema)
