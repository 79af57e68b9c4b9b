"""Licence scans: parts and windows of a text against licence templates by the Dice coefficient over word bigrams.

A text's parts are the whole text, its paragraphs, lines and sentences, all normalised to lower-case words. An index from
bigram to templates finds the parts that share anything with a template; size bounds leave only templates whose number of
bigrams can reach the threshold with the part's; the rest are compared exactly, over multisets of bigrams.

A licence can also stand within a part or run over several, so windows of words are compared too, wherever they begin and
end. The size bounds say how many of a template's bigrams a window holds at least and how long it is at most; only starts
with so many within reach are searched, and those exactly.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestream.llm.common import map_texts

THRESHOLD_PERCENT = 80

# Licence notices and texts, by SPDX identifier.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR
BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = _BSD_2 + """ Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_DISCLAIMER = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not
be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in
the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must
not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software,
unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_LESSER = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version. This
library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""
_AFFERO = _GPL.replace("GNU General", "GNU Affero General")
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_UNLICENSE_MORE = """ Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication
for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law."""
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("ISC", _ISC),
    ("ISC", "Released under the ISC License."),
    ("BSD-2-Clause", _BSD_2 + _DISCLAIMER),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-3-Clause", _BSD_3 + _DISCLAIMER),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", _GPL.format(v=2)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", _GPL.format(v=3)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", _LESSER.format(v="2.1")),
    ("LGPL-3.0", _LESSER.format(v=3)),
    ("AGPL-3.0", _AFFERO.format(v=3)),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BOOST),
    ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE + _UNLICENSE_MORE),
    ("Unlicense", _UNLICENSE),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)

_WORD = re.compile(r"\w+")
_LINE = re.compile(r"[^\n]+")
_PARAGRAPH = re.compile(r"[^\n]+(?:\n[^\n]+)*")
_SENTENCE_END = re.compile(r"[.!?](?=\s)")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def parts(text: str) -> list[tuple[int, int]]:
    """(start, end) of the whole text, paragraphs, lines and sentences; each once, by start and then the longest first."""
    out = {(0, len(text))}
    out.update(m.span() for m in _PARAGRAPH.finditer(text))
    for m in _LINE.finditer(text):
        out.add(m.span())
        at = m.start()
        for e in _SENTENCE_END.finditer(text, m.start(), m.end()):
            out.add((at, e.end()))
            at = e.end()
        out.add((at, m.end()))
    return sorted((s, e) for s, e in out if s < e)


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.names = [n for n, _ in templates]
        self.bags = [Counter(zip(w, w[1:], strict=False)) for w in (words_of(t) for _, t in templates)]
        self.sizes = [b.total() for b in self.bags]
        self.index: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, bag in enumerate(self.bags):
            for g in bag:
                self.index[g].append(i)
        self.index = dict(self.index)

    def windows(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """The same tuples as scan()'s, of windows of words: each template's best ones that share no words.

        A window within another template's, all of whose shared bigrams are that one's too, is left out: it is a piece of it.
        """
        if not text:
            return []
        lower = text.lower()
        words = _WORD.findall(lower)
        index = self.index
        hits: dict[int, list[int]] = defaultdict(list)
        for i, g in enumerate(zip(words, words[1:], strict=False)):
            for t in index.get(g, ()):
                hits[t].append(i)
        found = {t: w for t, at in hits.items() if (w := self._best_windows(words, t, at))}
        if not found:
            return []

        def is_piece(t: int, shared: int, first: int, last: int) -> bool:
            for u, others in found.items():
                # Windows of one template share no words, so only one can hold this one.
                k = bisect_right(others, first, key=lambda x: x[1]) - 1
                if self.names[u] != self.names[t] and k >= 0 and others[k][2] >= last and others[k][0] > shared:
                    own = set(zip(words[first : last + 1], words[first + 1 : last + 2], strict=True)) & self.bags[t].keys()
                    if own <= self.bags[u].keys():
                        return True
            return False

        whole = [(t, *w) for t, each in found.items() for w in each if not is_piece(t, *w)]
        at = [m.span() for m in _WORD.finditer(lower)]
        return sorted((t, shared, last - first + 1 + self.sizes[t], at[first][0], at[last + 1][1]) for t, shared, first, last in whole)

    def _best_windows(self, words: list[str], t: int, at: list[int]) -> list[tuple[int, int, int]]:
        """(shared, first and last bigram) of a template's best windows that share no words; at: its bigrams' places."""
        size, bag = self.sizes[t], self.bags[t]
        # A window of n bigrams shares at most min(n, size), and needs 2 * shared / (n + size) to reach the threshold.
        least = -(-THRESHOLD_PERCENT * size // (200 - THRESHOLD_PERCENT))
        most = (200 - THRESHOLD_PERCENT) * size // THRESHOLD_PERCENT
        best = []
        for k in range(len(at) - least + 1):
            first = at[k]
            if at[k + least - 1] - first >= most:
                continue
            left, shared, top = dict(bag), 0, None
            for j in range(k, len(at)):
                last = at[j]
                if last - first >= most:
                    break
                g = words[last], words[last + 1]
                if left[g]:
                    left[g] -= 1
                    shared += 1
                    n = last - first + 1 + size
                    if 200 * shared >= THRESHOLD_PERCENT * n and (top is None or shared * top[0] > top[1] * n):
                        top = n, shared, last
            if top is not None:
                best.append((-top[1] / top[0], -top[1], first, top[2]))
        # Spans of taken windows never meet, so the nearest two decide.
        firsts: list[int] = []
        taken: dict[int, tuple[int, int]] = {}
        for _, shared, first, last in sorted(best):
            i = bisect_left(firsts, first)
            if (i == 0 or taken[firsts[i - 1]][1] + 1 < first) and (i == len(firsts) or last + 1 < firsts[i]):
                firsts.insert(i, first)
                taken[first] = (-shared, last)
        return [(taken[f][0], f, taken[f][1]) for f in firsts]

    def scan(self, text: str | None) -> tuple[list[tuple[int, int, int, int, int]], int]:
        """((template, shared, sizes of both, start, end) of each part and template at or above the threshold, words)."""
        if not text:
            return [], 0
        lower = text.lower()
        words = _WORD.findall(lower)
        index = self.index
        hits = [i for i, g in enumerate(zip(words, words[1:], strict=False)) if g in index]
        if not hits:
            return [], len(words)
        # Some characters change length in lower case; parts are then cut from the lower-cased text.
        at = [m.start() for m in _WORD.finditer(lower)]
        out = []
        for s, e in parts(lower):
            first, last = bisect_left(at, s), bisect_left(at, e)
            k = bisect_left(hits, first)
            if k == len(hits) or hits[k] >= last - 1:
                continue
            size = last - 1 - first
            inside = hits[k : bisect_left(hits, last - 1)]
            # Size bounds: 2 min(a, b) / (a + b) must reach the threshold, and so must the hits there are.
            fits = {t for i in inside for t in index[words[i], words[i + 1]] if 200 * min(size, self.sizes[t], len(inside)) >= THRESHOLD_PERCENT * (size + self.sizes[t])}
            own = Counter((words[i], words[i + 1]) for i in inside) if fits else {}
            for t in sorted(fits):
                bag = self.bags[t]
                shared = sum(min(n, bag[g]) for g, n in own.items() if g in bag)
                if 200 * shared >= THRESHOLD_PERCENT * (size + self.sizes[t]):
                    out.append((t, shared, size + self.sizes[t], s, e))
        return out, len(words)


def scan_documents(df: DataFrame, text: str = "text", keep: list[str] | None = None, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Adds license, dice, licenses and part for each whole text.

    license is the identifier of the best match (greatest Dice coefficient, then most shared bigrams, then template order,
    then parts before windows), null if no part and no window reaches the threshold; dice its coefficient, else 0; licenses
    all matched identifiers, sorted and comma-joined; part the best match's start:end in the lower-cased text. Null and empty texts match nothing. Other columns pass unchanged; columns of
    the added names are replaced. No shuffle.
    """

    def make() -> Callable[[list[str | None]], list[list]]:
        scanner = Scanner(templates)

        def work(texts: list[str | None]) -> list[list]:
            out: list[list] = [[], [], [], []]
            for t in texts:
                found = [*scanner.scan(t)[0], *scanner.windows(t)]
                best = min(found, key=lambda x: (-2 * x[1] / x[2], -x[1], x[0]), default=None)
                row = (scanner.names[best[0]], 2 * best[1] / best[2], ",".join(sorted({scanner.names[x[0]] for x in found})), f"{best[3]}:{best[4]}") if best else (None, 0.0, "", None)
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            return out

        return work

    return map_texts(df, text, [("license", T.StringType()), ("dice", T.DoubleType()), ("licenses", T.StringType()), ("part", T.StringType())], make, keep)
