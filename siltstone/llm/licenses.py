"""Operator 8: license scans by template-markup matching.

A template is license wording with marked regions: ``<<optional>> ... <<end>>`` may be left out and
``<<any 0-20>>`` stands for that many words of any kind. Templates compile into automata over
words; a text is accepted where one run from its first mandatory word reaches the end, so all
mandatory wording must match exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import words_of

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: License wording by label, in template markup: whole texts of the short licenses; of the long ones (Apache, GPL, MPL) the whole notices that name them.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<optional>>(including the next paragraph)<<end>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE <<any 1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-statement": "<<optional>>Released<<end>> <<optional>>Licensed<<end>> <<optional>>Distributed<<end>> under the <<optional>>terms of the<<end>> MIT License",
    "apache-2.0-statement": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<any 1-12>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-statement": "licensed under the <<optional>>terms of the<<end>> GNU <<optional>>Lesser<<end>> <<optional>>Affero<<end>> General Public License<<optional>>, version <<any 1-1>><<end>>",
    "gpl-notice": "<<any 1-6>> is free software<<any 0-1>> you can redistribute it and/or modify it under the terms of the GNU <<optional>>Lesser<<end>> <<optional>>Affero<<end>> General Public License as published by the Free Software Foundation<<any 0-1>> either version <<any 1-2>> of the License, or (at your option) any later version. <<any 1-6>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU <<optional>>Lesser<<end>> <<optional>>Affero<<end>> General Public License for more details. You should have received a copy of the GNU <<optional>>Lesser<<end>> <<optional>>Affero<<end>> General Public License along with <<any 1-6>> if not, <<any 1-24>>",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<any 0-2>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<any 0-2>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <<optional>><<any 0-2>> Neither the name of <<any 1-12>> nor the names of <<any 1-4>> may be used to endorse or promote products derived from this software without specific prior written permission.<<end>> THIS SOFTWARE IS PROVIDED BY THE <<any 1-12>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE <<any 1-12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-text": "Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND <<any 1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<any 1-12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<any 0-2>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<any 0-2>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<any 0-2>> This notice may not be removed or altered from any source distribution.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<any 1-8>>",
    "cc-statement": "Licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY<<optional>>-NC<<end>><<optional>>-SA<<end>><<optional>>-ND<<end>> <<any 2-2>>",
    "spdx-tag": "SPDX-License-Identifier: <<any 1-1>>",
}
_MARK = re.compile(r"<<\s*(optional|end|any\s+(\d+)-(\d+))\s*>>")


class Automaton:
    """States by number: ``words`` to the next states, ``free`` where any word will do, ``skip`` without a word."""

    def __init__(self, template: str):
        self.words: list[dict[bytes, int]] = [{}]
        self.free: list[int | None] = [None]
        self.skip: list[set[int]] = [set()]
        opened, runs, depth, last = [], [], 0, 0
        for part in re.split(r"(<<[^<>]*>>)", template):
            mark = _MARK.fullmatch(part)
            if mark is None:
                run = words_of(part)
                if run and not depth:
                    runs.append(b" ".join(run))
                for w in run:
                    at = len(self.words) - 1
                    self.words[at][w] = self._state()
            elif mark[1] == "optional":
                opened.append(len(self.words) - 1)
                depth += 1
            elif mark[1] == "end":
                self.skip[opened.pop()].add(len(self.words) - 1)
                depth -= 1
            else:
                starts = []
                for i in range(int(mark[3])):
                    if i >= int(mark[2]):
                        starts.append(len(self.words) - 1)
                    at = len(self.words) - 1
                    self.free[at] = self._state()
                for s in starts:
                    self.skip[s].add(len(self.words) - 1)
        self.final = len(self.words) - 1
        self.anchor = max(runs, key=len)  # mandatory words in a row: without them, nothing can match
        self.begin = self._closed({0})
        self.firsts = None if any(self.free[s] is not None for s in self.begin) else {w for s in self.begin for w in self.words[s]}

    def _state(self) -> int:
        self.words.append({})
        self.free.append(None)
        self.skip.append(set())
        return len(self.words) - 1

    def _closed(self, states: set[int]) -> set[int]:
        found, rest = set(states), list(states)
        while rest:
            for t in self.skip[rest.pop()] - found:
                found.add(t)
                rest.append(t)
        return found

    def end(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest accepted run of words from ``start``, or None."""
        states, best = self.begin, None
        for i in range(start, len(words)):
            w = words[i]
            after = {self.words[s][w] for s in states if w in self.words[s]}
            after |= {self.free[s] for s in states if self.free[s] is not None}
            if not after:
                break
            states = self._closed(after)
            if self.final in states:
                best = i + 1
        return best

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Accepted (start, end) in words, leftmost first and not overlapping."""
        out, at = [], 0
        while at < len(words):
            end = self.end(words, at) if self.firsts is None or words[at] in self.firsts else None
            if end is None:
                at += 1
            else:
                out.append((at, end))
                at = end
        return out


def phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers where ``phrase`` starts in ``joined``, words between single spaces with one at either end."""
    out, at, counted, n = [], joined.find(phrase), 0, 0
    while at >= 0:
        n += joined.count(b" ", counted, at + 1)
        counted = at + 1
        out.append(n - 1)
        at = joined.find(phrase, at + 1)
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """Licenses named or quoted in every whole text.

    Rows: id, n_words, n_base (places of all base phrases), first_word, last_word (their smallest
    and largest start, null without one), base_labels, labels (with those of accepted templates),
    score (1.0 if a template accepts a part of the text, else n / (n + 1) for n base places),
    matches (array of struct label, first_word, end_word). One row for each row of ``docs``: null
    text counts as empty; repeated rows repeat; null ids stay null; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    marked = templates or TEMPLATES

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [(label, Automaton(t)) for label, t in marked.items()]
        phrases = [(b" " + p.encode() + b" ", label) for p, label in PHRASES.items()]
        for batch in rows:
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                joined = b" " + b" ".join(words) + b" "
                places = {label: phrase_places(joined, p) for p, label in phrases}
                base = sorted(label for label, at in places.items() if at)
                starts = [i for at in places.values() for i in at]
                found = [(label, *m) for label, a in automata if b" " + a.anchor + b" " in joined for m in a.find(words)]
                n = len(starts)
                score = 1.0 if found else n / (n + 1)
                out.append((len(words), n, min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *(m[0] for m in found)})), score, [{"label": m[0], "first_word": m[1], "end_word": m[2]} for m in found]))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))]
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    schema = f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label string, first_word long, end_word long>>"
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
