"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates and documents are words in lower case. Hashes of five words are winnowed and looked up in an
inverted index of the templates; hits on close diagonals are a candidate, whose words are aligned with the
template's within a band. A match needs four fifths of the template's words. Of matches that overlap, the one
with more matched words stays.

Parts of a template that lie too far apart for one band, and are too small each, are chained where they are in
the same order in both texts, with at most as many words between two of them as the template has.

Templates with fewer hashes than a winnowing window are looked up with all hashes of a document, so that an
exact occurrence of any template is a candidate.

Defined cases: a null or empty text has no match; repeated rows and null ids give a row each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import ALNUM, chunks, mix, utf8, words

SHINGLE, WINNOW, COVERAGE = 5, 4, 0.8
MATCH, MISMATCH, GAP = 2, -1, -1
#: Texts and notices of licenses in common use, without their lines of copyright. Of a license with several, each is looked for.
AS_IS_MIT = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
AS_IS_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
AS_IS_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
UNLICENSE_REST = "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
AS_IS_UNLICENSE = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
GPL_REST = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
GPL3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
GPL2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": ["Released under the MIT License.", MIT, f"{MIT} {AS_IS_MIT}"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", GPL3, f"{GPL3} {GPL_REST}"],
    "GPL-2.0": [GPL2, f"{GPL2} {GPL_REST}"],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "BSD-2-Clause": [f"{BSD} {AS_IS_BSD}"],
    "BSD-3-Clause": [f"{BSD} {BSD_NAMES}", f"{BSD} {BSD_NAMES} {AS_IS_BSD}"],
    "ISC": [ISC, f"{ISC} {AS_IS_ISC}"],
    "Zlib": [ZLIB],
    "Unlicense": [UNLICENSE, f"{UNLICENSE} {UNLICENSE_REST} {AS_IS_UNLICENSE}"],
}


def grams(codes: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the `size` words from each place, and whether they are of one row."""
    n = len(codes)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h[: max(0, n - size + 1)] = mix(h[: max(0, n - size + 1)] * np.uint64(0x9FB21C651E98DF25) + codes[j : max(j, n - size + 1 + j)])
    whole = np.zeros(n, bool)
    row = np.searchsorted(ends, np.arange(n), "right")
    whole[:] = np.arange(n) + size <= ends[row] if n else whole
    return h, whole


def winnow(h: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Places that are the least of some window of WINNOW hashes, the rightmost of equals."""
    n = len(h)
    top = np.uint64((1 << 64) - 1)
    value = np.full(n + 2 * (WINNOW - 1), top, np.uint64)
    value[WINNOW - 1 : WINNOW - 1 + n] = np.where(whole, h, top)
    windows = np.lib.stride_tricks.sliding_window_view(value, WINNOW)
    at = np.arange(len(windows)) + WINNOW - 1 - np.argmin(windows[:, ::-1], axis=1) - (WINNOW - 1)
    at = at[(at >= 0) & (at < n)]
    return np.unique(at[whole[at]])


class Index:
    """The templates' words and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, list[str]]):
        own = [(name, text) for name, texts in templates.items() for text in texts]
        data, offsets = utf8(pa.array([t for _, t in own], pa.string()))
        w = words(data, offsets, ALNUM)
        self.names = [n for n, _ in own]
        cut = np.concatenate([[0], w.ends])
        self.codes = [w.hash[a:b] for a, b in zip(cut[:-1], cut[1:])]
        h, whole = grams(w.hash, w.ends)
        row = np.searchsorted(w.ends, np.arange(len(h)), "right")
        few = np.array([max(0, len(c) - SHINGLE + 1) < WINNOW for c in self.codes])
        some = np.zeros(len(h), bool)
        some[winnow(h, whole)] = True
        self.tables = []
        for chosen in (whole & few[row], some & ~few[row]):
            at = np.flatnonzero(chosen)
            at = at[np.argsort(h[at], kind="stable")]
            self.tables.append((h[at], row[at], at - cut[row[at]]))


def aligned(template: np.ndarray, text: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """Local alignment on diagonals (text place - template place) from low to high: places of matched words in template and text."""
    best, end = 0, (0, 0)
    score: dict[tuple[int, int], int] = {}
    step: dict[tuple[int, int], tuple[int, int] | None] = {}
    for i in range(len(template)):
        for j in range(max(0, i + low), min(len(text), i + high + 1)):
            same = MATCH if template[i] == text[j] else MISMATCH
            options = [(0, None), (score.get((i - 1, j - 1), 0) + same, (i - 1, j - 1)), (score.get((i - 1, j), 0) + GAP, (i - 1, j)), (score.get((i, j - 1), 0) + GAP, (i, j - 1))]
            score[i, j], step[i, j] = max(options, key=lambda o: o[0])
            if score[i, j] > best:
                best, end = score[i, j], (i, j)
    pairs, at = [], end if best else None
    while at is not None and score.get(at, 0) > 0:
        before = step[at]
        if before == (at[0] - 1, at[1] - 1) and template[at[0]] == text[at[1]]:
            pairs.append(at)
        at = before
    return pairs[::-1]


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Of the local alignment: matched words, first and last place in text."""
    pairs = aligned(template, text, low, high)
    return (len(pairs), pairs[0][1], pairs[-1][1]) if pairs else (0, 0, 0)


def chained(parts: list[list[tuple[int, int]]], reach: int) -> Iterator[tuple[int, int, int]]:
    """Matched words, first and last place in text of the best chain that ends with each part but the chain's first."""
    parts = sorted(parts, key=lambda p: (p[-1][1], p[-1][0]))
    best: list[tuple[int, int]] = []
    for k, own in enumerate(parts):
        here = (len(own), own[0][1])
        for j in range(k - 1, -1, -1):
            t, x = parts[j][-1]
            if x + reach < own[0][1]:
                break
            more = [b for a, b in own if a > t and b > x]
            if more and more[0] - x <= reach + 1:
                here = max(here, (best[j][0] + len(more), best[j][1]))
        best.append(here)
        if here[0] > len(own):
            yield here[0], here[1], own[-1][1]


def matches(codes: np.ndarray, ends: np.ndarray, index: Index, coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, template, matched words, first and last word in the row) of all matches, overlapping ones too."""
    h, whole = grams(codes, ends)
    begin = np.concatenate([[0], ends])
    found = []
    for (keys, which, place), at in zip(index.tables, (np.flatnonzero(whole), winnow(h, whole))):
        low, high = np.searchsorted(keys, h[at]), np.searchsorted(keys, h[at], "right")
        on = high > low
        at, low, high = at[on], low[on], high[on]
        each = high - low
        k = np.repeat(low - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
        at = np.repeat(at, each)
        row = np.searchsorted(ends, at, "right")
        found.append(np.column_stack([row, which[k], at - begin[row] - place[k]]))
    hits = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    at, parts = 0, []
    while at < len(hits):
        row, which, low = hits[at].tolist()
        template = index.codes[which]
        band = min(8, len(template) // 4)
        last = at
        while last + 1 < len(hits) and (hits[last + 1][:2] == hits[at][:2]).all() and hits[last + 1][2] - hits[last][2] <= band and hits[last + 1][2] - low <= 2 * band:
            last += 1
        high = int(hits[last][2])
        text = codes[begin[row] : begin[row + 1]]
        first = max(0, low - band)
        stop = min(len(text), high + band + len(template))
        if 0 <= low == high and np.array_equal(text[low : low + len(template)], template):
            pairs = [(i, low + i) for i in range(len(template))]  # word for word: no alignment is better
        else:
            pairs = [(i, first + j) for i, j in aligned(template, text[first:stop], low - band - first, high + band - first)]
        if len(pairs) >= coverage * len(template):
            yield row, which, len(pairs), pairs[0][1], pairs[-1][1]
        elif pairs:
            parts.append(pairs)
        at = last + 1
        if at == len(hits) or hits[at][0] != row or hits[at][1] != which:
            for n, a, b in chained(parts, len(template)):
                if n >= coverage * len(template):
                    yield row, which, n, a, b
            parts = []


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_matches, licenses, coverage, matched_words and spans.

    licenses: the names found, sorted; coverage: the largest share of a template's words; spans: name:start:end
    in code points, in order.
    """
    templates = TEMPLATES if templates is None else templates
    schema = pa.schema([("doc_id", pa.int64()), ("n_matches", pa.int64()), ("licenses", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int64()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for first, last in chunks(offsets):
                own, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                w = words(own, at, ALNUM)
                begin = np.concatenate([[0], w.ends])
                by_row: dict[int, list] = {}
                for row, which, n, a, b in matches(w.hash, w.ends, index, coverage):
                    by_row.setdefault(row, []).append((-n, -n / len(index.codes[which]), a, b, which))
                out = []
                for row in range(last - first):
                    kept: list[tuple] = []  # in order, none overlaps another
                    for n, share, a, b, which in sorted(by_row.get(row, ())):
                        k = bisect_left(kept, (a,))
                        if (k == 0 or kept[k - 1][1] < a) and (k == len(kept) or kept[k][0] > b):
                            kept.insert(k, (a, b, index.names[which], -n, -share))
                    spans = []
                    if kept:
                        points = np.cumsum((own[at[row] : at[row + 1]] & 0xC0) != 0x80)
                        for a, b, name, *_ in kept:
                            s, e = w.start[begin[row] + a] - at[row], w.end[begin[row] + b] - at[row]
                            spans.append(f"{name}:{points[s] - 1}:{points[e - 1]}")
                    out.append((len(kept), ",".join(sorted({k[2] for k in kept})), max((k[4] for k in kept), default=0.0), sum(k[3] for k in kept), ",".join(spans)))
                columns = [batch.column("doc_id").slice(first, last - first), *zip(*out)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, n_matches long, licenses string, coverage double, matched_words long, spans string")
