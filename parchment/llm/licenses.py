"""License scans: patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices

#: Notices and texts of public licenses; longer texts are in files beside this one, read by the driver.
TEMPLATES = {
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mpl-2.0": "Licensed under the Mozilla Public License, version 2.0.",
    "mit": "Released under the MIT License.",
    "bsd": "Released under the BSD License.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}
#: Words that name a short notice's license; all must be aligned, as other notices differ from it in these alone.
NAMES = {
    "cc-by-4.0": "cc by 4", "cc-by-sa-4.0": "cc by sa 4", "cc-by-nc-4.0": "cc by nc 4", "cc-by-nd-4.0": "cc by nd 4", "cc-by-nc-sa-4.0": "cc by nc sa 4",
    "apache-2.0": "apache 2", "gpl-2.0": "gnu general 2", "gpl-3.0": "gnu general 3", "mpl-2.0": "mozilla 2", "mit": "mit license", "bsd": "bsd license",
    "cc-by-4.0-notice": "creative commons attribution 4", "cc-by-sa-4.0-notice": "commons sharealike 4", "cc-by-nc-4.0-notice": "commons noncommercial 4",
    "gpl-2.0-notice": "version 2", "gpl-3.0-notice": "version 3", "bsd-3-clause-text": "endorse promote",
}
LONG_TEXTS = Path(__file__).with_name("license_texts")
#: A template is found where so large a share of its words is aligned.
COVERAGE = 0.8
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def patience(a: list[str], b: list[str], shift_a: int = 0, shift_b: int = 0) -> list[tuple[int, int]]:
    """Aligned places of two lists of words.

    Equal ends are taken off; between them, words that occur once on either side are anchors, and the longest rising run
    of these (by patience sorting) is kept. The gaps between its anchors are aligned in the same way, until one has none.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, x, y = todo.pop()
        while i < j and x < y and a[i] == b[x]:
            out.append((i, x))
            i, x = i + 1, x + 1
        while i < j and x < y and a[j - 1] == b[y - 1]:
            j, y = j - 1, y - 1
            out.append((j, y))
        if i == j or x == y:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[x:y])
        at = {w: k for k, w in enumerate(a[i:j], i) if in_a[w] == 1 and in_b.get(w) == 1}
        pairs = [(k, at[w]) for k, w in enumerate(b[x:y], x) if w in at]
        ends: list[int] = []
        tops: list[int] = []
        before: list[int] = []
        for n, (_, k) in enumerate(pairs):
            pile = bisect_left(ends, k)
            before.append(tops[pile - 1] if pile else -1)
            ends[pile : pile + 1], tops[pile : pile + 1] = [k], [n]
        line, n = [], tops[-1] if tops else -1
        while n >= 0:
            line.append((pairs[n][1], pairs[n][0]))
            n = before[n]
        if not line:
            continue
        line.reverse()
        out += line
        edges = [(i - 1, x - 1), *line, (j, y)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted((p + shift_a, q + shift_b) for p, q in out)


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, words(text)
        self.named = set(NAMES.get(name, "").split())
        self.counts = Counter(self.words)
        self.slack = 2 + round((1 - COVERAGE) * len(self.words))
        # Coverage leaves few words out, so one of any that hold a larger share is in every text that has it.
        held, self.probes = 0, {}
        for w in sorted(self.counts, key=lambda w: (self.counts[w], -len(w), w)):
            if held > (1 - COVERAGE) * len(self.words):
                break
            held += self.counts[w]
            self.probes[w] = [k for k, x in enumerate(self.words) if x == w]

    def find(self, text: list[str], places: dict[str, list[int]], counts: Counter) -> list[tuple[int, int, int]]:
        """(words aligned, start, end) of each place, in words of the text, where the template is found.

        A probe word tells where the template would begin. Such beginnings, taken together where they lie closer than the
        words that may be missing, each give a window as wide as the template, which is aligned by itself; so copies that
        follow each other are found one by one."""
        size = len(self.words)
        need = COVERAGE * size
        if len(text) < need or sum(min(n, counts[w]) for w, n in self.counts.items()) < need:
            return []
        starts = sorted({i - k for w, at in self.probes.items() for i in places.get(w, ()) for k in at})
        out: list[tuple[int, int, int]] = []
        n = 0
        while n < len(starts):
            first = last = starts[n]
            while n < len(starts) and starts[n] - first <= self.slack:
                last = starts[n]
                n += 1
            for a, b in ((max(first, 0), last + size), (first - self.slack, last + size + self.slack)):
                a = max(a, out[-1][2] if out else 0)
                aligned = patience(self.words, text[a:b], 0, a) if b - a >= need else []
                if len(aligned) >= need and self.named <= {self.words[k] for k, _ in aligned}:
                    out.append((len(aligned), aligned[0][1], aligned[-1][1] + 1))
                    break
        return out


def templates(more: dict[str, str] | None = None) -> list[Template]:
    """The templates of this module, or those given; a bounded table that tasks hold as a whole."""
    known = more or TEMPLATES | {f"{p.stem}-text": p.read_text() for p in LONG_TEXTS.glob("*.txt")}
    return [Template(k, v) for k, v in sorted(known.items())]


def find_all(text: str | None, known: list[Template]) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end), in characters, of the templates in a text; of those that overlap, the one with most aligned words."""
    spans = [m.span() for m in _WORD.finditer(text or "")]
    line = [text[a:b].lower() for a, b in spans]
    counts = Counter(line)
    probes = set().union(*(t.probes for t in known))
    places: dict[str, list[int]] = {}
    for i, w in enumerate(line):
        if w in probes:
            places.setdefault(w, []).append(i)
    found = sorted(((-n, a, b, t) for t in known for n, a, b in t.find(line, places, counts)), key=lambda x: (*x[:3], x[3].name))
    kept: list[tuple[str, float, int, int]] = []
    taken: list[tuple[int, int]] = []
    for n, a, b, t in found:
        if all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            kept.append((t.name, -n / len(t.words), spans[a][0], spans[b - 1][1]))
    return sorted(kept, key=lambda x: x[2])


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", texts: dict[str, str] | None = None) -> DataFrame:
    """(id, license, coverage, start_char, end_char) for each place in a whole text where a template is found.

    Words are letters and digits, in lower case. Of templates that overlap, the one with most aligned words is reported
    (ties: by name). Rows are taken one by one, without a shuffle, texts of any length as a whole; templates are a parameter
    shipped with the code. Null, empty and other texts without a license give no row; repeated rows give repeated ones, an
    empty table an empty one. Other columns are not read.
    """
    kind = docs.select(id).schema[0].dataType.simpleString()
    known = templates(texts)
    # A word of every template's names or probes: a text with none of them has no license.
    quick = re.compile("|".join(sorted({re.escape(min(t.named or t.probes, key=lambda w: (-len(w), w))) if t.named else "|".join(sorted(map(re.escape, t.probes))) for t in known})), re.I)

    def run(batches):
        for batch in slices(batches, "text"):
            rows, found = [], []
            for row, t in enumerate(batch["text"].to_pylist()):
                if t and quick.search(t):
                    for one in find_all(t, known):
                        rows.append(row), found.append(one)
            names, shares, starts, ends = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["id", "license", "coverage", "start_char", "end_char"])

    found = in_arrow(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), run, f"id {kind}, license string, coverage double, start_char int, end_char int")
    return found.withColumnRenamed("id", id)
