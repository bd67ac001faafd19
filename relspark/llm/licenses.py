"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment.

The templates are a parameter, and their index is bounded by them, not by the corpus: it goes to the
tasks with the function. Every run of GRAM template words in a document is looked up, so a document
that holds any selected fingerprint of a template becomes its candidate; hits of one
diagonal band are aligned once, over template and document words, within the band.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import texts

GRAM, WINNOW = 3, 4
#: Share of a template's words that an alignment matches at least.
COVERAGE = 0.7
_WORD = re.compile(r"\w+(?:[.-]\w+)*")

# The wording of common license notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
        more details.""",
    "bsd-3-clause-whole": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
        COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
        (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE.""",
    "isc-whole": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "mit-line": "Released under the MIT License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software.""",
    "mit-whole": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}


def folded(text: str) -> str:
    """``text`` in lower case with every character's place kept."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def winnow(hashes: list[int], window: int = WINNOW) -> set[int]:
    """The places of the smallest hash (the last of equals) of each ``window`` consecutive ones; of all, if they are fewer."""
    if not hashes:
        return set()
    out = set()
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i : i + window]
        least = min(part)
        out.add(i + max(j for j, h in enumerate(part) if h == least))
    return out


class Index:
    """Word numbers of the templates, and the inverted index from a gram of them to (template, place)."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        words = [_WORD.findall(folded(templates[n])) for n in self.names]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for t in words for w in t}))}
        self.words = [np.array([self.number[w] for w in t], np.int64) for t in words]
        self.base = len(self.number) + 1
        self.posts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
        for k, t in enumerate(self.words):
            if len(t) < GRAM:  # too short for a gram: looked up by its first word
                if len(t):
                    self.short[int(t[0])].append((k, tuple(t.tolist())))
                continue
            grams = self.grams(t).tolist()
            hashes = [xxhash.xxh64_intdigest(b"%d" % g) for g in grams]
            for i in winnow(hashes):
                self.posts[grams[i]].append((k, i))
        self.known = np.array(sorted(self.posts), np.int64)

    def grams(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(max(0, len(numbers) - GRAM + 1), np.int64)
        for j in range(GRAM):
            out = out * self.base + numbers[j : j + len(out)]
        return out

    def candidates(self, numbers: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, lowest and highest diagonal) of bands of hits; a diagonal is a place in the document less one in the template."""
        hits: dict[int, set[int]] = defaultdict(set)
        if len(numbers) >= GRAM and len(self.known):
            grams = self.grams(numbers)
            whole = np.convolve(numbers > 0, np.ones(GRAM, np.int64), "valid") == GRAM
            for at in np.flatnonzero(whole & np.isin(grams, self.known)).tolist():
                for k, i in self.posts[int(grams[at])]:
                    hits[k].add(at - i)
        for first, templates in self.short.items():
            for at in np.flatnonzero(numbers == first).tolist():
                for k, t in templates:
                    if tuple(numbers[at : at + len(t)].tolist()) == t:
                        hits[k].add(at)
        out = []
        for k, diagonals in hits.items():
            band, low, high = self.band(k), None, None
            for d in sorted(diagonals):
                if low is None or d - low > band:
                    if low is not None:
                        out.append((k, low, high))
                    low = d
                high = d
            out.append((k, low, high))
        return out

    def band(self, k: int) -> int:
        """How far an alignment may drift from its hits' diagonals."""
        return min(16, len(self.words[k]) // 8 + 1)

    def exact(self, numbers: np.ndarray, k: int, low: int, high: int) -> int | None:
        """The first place of the band at which the template stands word by word."""
        t = self.words[k]
        for d in range(max(low, 0), min(high, len(numbers) - len(t)) + 1):
            if numbers[d] == t[0] and np.array_equal(numbers[d : d + len(t)], t):
                return d
        return None

    def align(self, numbers: np.ndarray, k: int, low: int, high: int) -> tuple[int, int, int]:
        """Matched words and the first and last of them in the document, of the longest common subsequence within the band."""
        t, band = self.words[k].tolist(), self.band(k)
        first, width = low - band, high - low + 2 * band + 1
        n = len(numbers)
        # row[c]: best (matches, -start, end) of template words so far with the document up to first + i + c
        row: list[tuple[int, int, int]] = [(0, 0, -1)] * (width + 1)
        for i, word in enumerate(t):
            new = [(0, 0, -1)] * (width + 1)
            for c in range(width):
                at = first + i + c
                best = max(row[c + 1], new[c - 1] if c else (0, 0, -1))
                if 0 <= at < n and numbers[at] == word:
                    m, s, _ = row[c]
                    best = max(best, (m + 1, s if m else -at, at))
                new[c] = best
            row = new
        m, s, e = max(row)
        return m, -s, e


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, license, coverage, matched_words, start, end``: a row for each template found in a text.

    ``start`` and ``end`` (exclusive) are code points of the matched part; ``coverage`` is the share of
    the template's words that a band's alignment matches in order; a template that stands there word by word needs no alignment. Overlapping finds of one
    template keep the better one (ties: the first); finds of different templates may overlap. Null
    and empty texts, and texts without a template, give no row; repeated rows repeat theirs; an
    empty table or no templates give none. Columns other than ``doc_id`` and ``text`` are ignored.
    """
    index = Index(TEMPLATES if templates is None else templates)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def found(text: str) -> list[tuple[str, float, int, int, int]]:
        low = folded(text)
        words = _WORD.findall(low)
        numbers = np.array(list(map(index.number.get, words, [0] * len(words))), np.int64)
        bands = index.candidates(numbers)
        if not bands:
            return []
        spans = [m.span() for m in _WORD.finditer(low)]
        finds: dict[int, list[tuple[float, int, int, int]]] = defaultdict(list)
        for k, a, b in bands:
            at = index.exact(numbers, k, a, b)
            m, s, e = index.align(numbers, k, a, b) if at is None else (len(index.words[k]), at, at + len(index.words[k]) - 1)
            if m >= coverage * len(index.words[k]):
                finds[k].append((-m / len(index.words[k]), spans[s][0], spans[e][1], m))
        out = []
        for k, each in finds.items():
            taken: list[tuple[int, int]] = []
            for c, s, e, m in sorted(each):
                # finds that are taken don't overlap, so only the nearest on either side can be in the way
                i = bisect_left(taken, (s, e))
                if (i == 0 or taken[i - 1][1] <= s) and (i == len(taken) or e <= taken[i][0]):
                    insort(taken, (s, e))
                    out.append((index.names[k], round(-c, 6), m, s, e))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [found(t) for t in texts(b.column("text"))]
            at = pa.array(np.repeat(np.arange(len(each)), [len(f) for f in each]))
            flat = [x for f in each for x in f]
            columns = [pa.array([x[i] for x in flat], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), *columns], names=["doc_id", "license", "coverage", "matched_words", "start", "end"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, license string, coverage double, matched_words long, start long, end long")
