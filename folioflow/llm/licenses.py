"""License scans by patience alignment of texts with license templates.

Within a stretch of text, words unique to it and to the template that occur in both are
anchors; the longest increasing subsequence of their places is kept, and the gaps between
are aligned in turn, after their common ends are taken off. A gap without anchors is
aligned by its longest common subsequence. Coverage is the share of the template's words
that are aligned; what tells a license from others, its name and version, must stand
there as it is. Stretches begin near words that few other texts hold: the template's own
rare words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow.llm.common import batch_of, map_arrow, slices, texts
from folioflow.llm.decontamination import words

#: Share of the template that must be aligned.
COVERAGE = 0.8
#: A stretch of text is longer than the template by one part in so many at each end, and by two words at least: room for words put in.
SLACK = 4

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. """
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution. """
_BSD_NAMES = """3. *Neither the name* of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission. """
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the *{name} as published
by the Free Software Foundation*{sep} *either version {version} of the License*, or (at your option) any later version.
This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."""

#: Phrases between asterisks must stand in the text word for word; they tell the license from those like it.
TEMPLATES = {
    "MIT": _MIT + _AS_IS,
    "MIT-grant": _MIT,
    "MIT-line": "Released under the *MIT License*",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": _BSD + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD + _BSD_NAMES + _BSD_WARRANTY,
    "BSD-conditions": _BSD,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor.""",
    "Apache-2.0": """Licensed under the *Apache License, Version 2.0* (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "Apache-2.0-line": "Licensed under the *Apache License, Version 2.0*",
    "GPL-2.0": _GNU.format(thing="program", mark=";", name="GNU General Public License", sep=";", version=2),
    "GPL-3.0": _GNU.format(thing="program", mark=":", name="GNU General Public License", sep=",", version=3),
    "LGPL-2.1": _GNU.format(thing="library", mark=";", name="GNU Lesser General Public License", sep=";", version="2.1"),
    "LGPL-3.0": _GNU.format(thing="program", mark=":", name="GNU Lesser General Public License", sep=",", version=3),
    "AGPL-3.0": _GNU.format(thing="program", mark=":", name="GNU Affero General Public License", sep=",", version=3),
    "GPL-2.0-line": "licensed under the *GNU General Public License, version 2*",
    "GPL-3.0-line": "licensed under the *GNU General Public License, version 3*",
    "LGPL-3.0-line": "licensed under the *GNU Lesser General Public License, version 3*",
    "AGPL-3.0-line": "licensed under the *GNU Affero General Public License, version 3*",
    "MPL-2.0": """This Source Code Form is subject to the terms of the *Mozilla Public License, v. 2.0*. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the *Eclipse Public License 2.0*
which is available at https://www.eclipse.org/legal/epl-2.0""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the
benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act
of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "CC0-1.0": """To the extent possible under law, the author has *waived all copyright* and related or neighboring rights to this
work.""",
    "CC0-1.0-line": "Licensed under *CC0 1.0*",
    "CC-BY-NC-4.0-line": "Licensed under *CC BY-NC 4.0*",
    "CC-BY-SA-4.0-line": "Licensed under *CC BY-SA 4.0*",
    "CC-BY-ND-4.0-line": "Licensed under *CC BY-ND 4.0*",
    "CC-BY-NC-SA-4.0-line": "Licensed under *CC BY-NC-SA 4.0*",
    "CC-BY-NC-ND-4.0-line": "Licensed under *CC BY-NC-ND 4.0*",
    "CC-BY-4.0-line": "Licensed under *CC BY 4.0*",
}

_COMMON = set("the of and to in a is that for it was on with as by at this from be are or an not any all you may can use under without".split())


class Template:
    def __init__(self, name: str, text: str):
        self.name = name
        pieces = [[w.decode() for w in words(part.encode())] for part in text.split("*")]
        self.words = [w for p in pieces for w in p]
        #: (first, end) of the phrases that must be aligned, and stand in the text without a gap.
        ends = [sum(map(len, pieces[: i + 1])) for i in range(len(pieces))]
        self.phrases = [(ends[i - 1], ends[i]) for i in range(1, len(pieces), 2)]
        self.counts = Counter(self.words)
        self.rare = {w for w in self.words if w not in _COMMON and not w.isdigit()}
        #: With so many of its words left out at most, one of the first of these is always there.
        spare = len(self.words) - need(self)
        self.first: dict[str, int] = {}
        seen = 0
        for i, w in enumerate(self.words):
            if w in self.rare:
                self.first.setdefault(w, i)
                seen += 1
                if seen > spare:
                    break


def need(t: Template, coverage: float = COVERAGE) -> int:
    """Words of the template that must be aligned."""
    return -int(-len(t.words) * coverage // 1)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, ordered by their first, whose second increases."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        before[i] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[at], piles[at] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by rows of bits: a zero marks where the length grows."""
    place: dict[str, int] = {}
    for j, w in enumerate(b):
        place[w] = place.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, now = [], full
    for w in a:
        hit = now & place.get(w, 0)
        now = (now + hit | now - hit) & full
        rows.append(now)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            out.append((i, j))
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of a and b, in order; of anchors that increase equally long, the one with the lower places is taken."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if cb[b[j]] == 1}
        if not place.keys() & {w for w, n in ca.items() if n == 1}:
            out += [(a0 + i, b0 + j) for i, j in common(a[a0:a1], b[b0:b1])]
            continue
        anchors = _increasing([(i, place[a[i]]) for i in range(a0, a1) if ca[a[i]] == 1 and a[i] in place])
        i0, j0 = a0, b0
        for i, j in anchors:
            out.append((i, j))
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, a1, j0, b1))
    return sorted(out)


def told(t: Template, got: list[tuple[int, int]]) -> bool:
    """Whether every phrase of the template is aligned, without a gap in the text."""
    at = {j: i for i, j in got}
    return all(s in at and all(at.get(j) == at[s] + j - s for j in range(s, e)) for s, e in t.phrases)


def scan(text: list[str], templates: list[Template]) -> list[tuple[str, int, int, float]]:
    """(license, first word, end word, coverage) of each stretch, left to right.

    Of stretches that overlap, the one with most words aligned stays; ties go to the
    higher coverage and the first name.
    """
    out = []
    vocabulary = set(text)
    for t in templates:
        n, least = len(t.words), need(t)
        if sum(c for w, c in t.counts.items() if w in vocabulary) < least:
            continue
        slack = max(2, n // SLACK)
        at = 0
        hits = [i for i, w in enumerate(text) if w in t.first]
        for i in hits:
            if i < at:
                continue
            s = max(at, i - t.first[text[i]] - slack)
            e = min(len(text), i - t.first[text[i]] + n + slack)
            part = text[s:e]
            held = Counter(w for w in part if w in t.counts)
            if sum(min(c, t.counts[w]) for w, c in held.items()) < least:
                continue
            got = aligned(part, t.words)
            if len(got) >= least and told(t, got):
                out.append((t.name, s + got[0][0], s + got[-1][0] + 1, len(got) / n, len(got)))
                at = s + got[-1][0] + 1
    kept: list[tuple] = []
    for x in sorted(out, key=lambda x: (-x[4], -x[3], x[0], x[1])):
        at = bisect_left(kept, (x[1],))
        if (at == 0 or kept[at - 1][1] <= x[1]) and (at == len(kept) or kept[at][0] >= x[2]):
            kept.insert(at, (x[1], x[2], x[0], x[3]))
    return [(name, s, e, share) for s, e, name, share in kept]


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_licenses", pa.int64()), ("licenses", pa.string()), ("coverage", pa.float64()), ("spans", pa.string())])
SCHEMA = "doc_id long, n_licenses long, licenses string, coverage double, spans string"


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """n_licenses (distinct), licenses (sorted names), coverage (the best, 0 without any) and spans (name:first word:end word) of each row of ``docs``.

    Null and empty texts hold none. Of stretches that overlap, ties go as ``scan`` says.
    Repeated rows are scanned each, alike; a null doc_id stays null, an empty table gives
    no rows, other columns are not read. Texts are scanned whole, however long, each in
    memory as one slice. Nothing is shuffled; templates are code or an argument, and small.
    """
    known = docs.sparkSession.sparkContext.broadcast([Template(k, v) for k, v in (TEMPLATES if templates is None else templates).items()])

    def run(batches):
        ts = known.value
        starts = {w.encode() for t in ts for w in t.first}
        for batch, raws in slices(batches):
            rows = []
            for raw in raws:
                w = words(raw)
                got = [] if starts.isdisjoint(w) else scan([x.decode() for x in w], ts)
                names = sorted({g[0] for g in got})
                rows.append((len(names), ",".join(names), max((g[3] for g in got), default=0.0), ",".join(f"{g[0]}:{g[1]}:{g[2]}" for g in got)))
            yield batch_of(_ARROW, [batch.column(0), *zip(*rows)])

    return map_arrow(texts(docs), run, SCHEMA)
