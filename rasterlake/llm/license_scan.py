"""Licence scans with a generalised suffix automaton of licence templates.

All templates' words go into one automaton, whose states know at which template places their strings end. A file's words
run through it: the state and matched length after each word are the matching statistics, the longest template passage
that ends there. Long maximal matches, placed by their states, are chained into spans, in the order of template and file,
and a span that covers enough of its template gives the template's label. Short phrases are templates too: a phrase stands
where its state is reached.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, Powers, byte_table, chunks, word_hashes, words

#: Phrases that always count, with their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Public licence texts without names and years, the notices that files carry, and short forms, by label.
TEMPLATES = {
    "mit": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE.""",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction""",
        "licensed under the MIT license",
    ],
    "bsd": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
        LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies""",
    ],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
        from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
        it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim
        that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
        is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.""",
    ],
    "bsl-1.0": [
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered
        by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the
        Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software
        and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the
        Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
        machine-executable object code generated by a source language processor.""",
    ],
    "unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
        this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions
        that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.
        We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
        overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    ],
    "apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a
        copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
        under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License""",
        "licensed under the Apache License, Version 2.0",
    ],
    "mpl-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You
        can obtain one at https://mozilla.org/MPL/2.0/.""",
    ],
    "gpl-notice": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be
        useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see
        <https://www.gnu.org/licenses/>.""",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later version""",
    ],
    "gpl-licensed": ["this work is licensed under the GNU General Public License version 3"],
    "cc0-1.0": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"],
    "cc-by-licensed": ["this work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["licensed under CC BY-NC 4.0"],
    "cc-by-sa": ["licensed under CC BY-SA 4.0"],
}


def plain_words(text: str) -> list[str]:
    raw = np.frombuffer(text.encode().lower(), np.uint8)
    starts, ends, _ = words(raw, np.array([0, len(raw)]), PLAIN)
    return [raw[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist())]


class SuffixAutomaton:
    """Of all templates, over word numbers; transitions are dictionaries."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: For each state, (template, end) of one place where its longest string ends.
        self.place: list[tuple[int, int]] = [(-1, -1)]
        self.last_states: list[int] = []
        for t, template in enumerate(templates):
            last = 0
            for i, word in enumerate(template):
                last = self._extend(last, word, (t, i))
            self.last_states.append(last)

    def _new(self, length: int, link: int, following: dict[int, int], place: tuple[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.place.append(place)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """q's strings of up to length[p] + 1 words as a state of their own."""
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]), self.place[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int, place: tuple[int, int]) -> int:
        q = self.next[last].get(word)
        if q is not None:  # an earlier template has this string
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._new(self.length[last] + 1, 0, {}, place), last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def run(self, word_ids: list[int]) -> Iterator[tuple[int, int]]:
        """(state, matched length) after each word."""
        state, length, following, link, lengths = 0, 0, self.next, self.link, self.length
        for w in word_ids:
            to = following[state].get(w)
            while to is None and state:
                state = link[state]
                length = lengths[state]
                to = following[state].get(w)
            if to is not None:
                state, length = to, length + 1
            yield state, length


class Scanner:
    """min_match: words of a match that may be part of a chain. min_cover: part of a template that a span must cover. max_gap: words between chained matches."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]], min_match: int = 4, min_cover: float = 0.6, max_gap: int = 8):
        texts = [plain_words(x) for x in (*phrases, *(t for some in templates.values() for t in some))]
        vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.lists = [[vocabulary[w] for w in t] for t in texts]
        self.labels = [*phrases.values(), *(label for label, some in templates.items() for _ in some)]
        self.n_phrases, self.min_match, self.min_cover, self.max_gap = len(phrases), min_match, min_cover, max_gap
        #: Words of the shortest run that can tell anything.
        self.least = min([min_match, *map(len, self.lists[: self.n_phrases])])
        self.automaton = SuffixAutomaton(self.lists)
        self.powers, self.table = Powers(51), byte_table(52, lower=True)
        joined = np.frombuffer(" ".join(vocabulary).encode(), np.uint8)
        s, e, _ = words(joined, np.array([0, len(joined)]), PLAIN)
        hashes = word_hashes(joined, s, e, self.table, self.powers) if len(s) else np.empty(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        # the phrases that end at a state: those of its links, and its own if it is a phrase's last state
        a = self.automaton
        ends = defaultdict(list)
        for i, state in enumerate(a.last_states[: self.n_phrases]):
            ends[state].append(i)
        by_length = sorted(range(1, len(a.next)), key=a.length.__getitem__)
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in a.next]
        for state in by_length:
            self.phrases[state] = self.phrases[a.link[state]] + [(i, len(self.lists[i])) for i in ends[state]]
        # (template, end) of all places where a state's strings end: its own and those of the states that link to it
        self.places: list[list[tuple[int, int]]] = [[] for _ in a.next]
        for t in range(self.n_phrases, len(self.lists)):
            state = 0
            for i, w in enumerate(self.lists[t], 1):
                state = a.next[state][w]
                self.places[state].append((t, i))
        for state in reversed(by_length):
            if a.length[a.link[state]] >= min_match:
                self.places[a.link[state]] += self.places[state]

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the vocabulary, -1 for other words."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1)

    def runs(self, ids: np.ndarray, first: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Of a stretch of vocabulary words: phrases (word, phrase), and maximal matches (first word, end word, state)."""
        found, matches, before = [], [], (0, 0)
        for i, (state, length) in enumerate(self.automaton.run(ids.tolist()), first):
            for p, n in self.phrases[state]:
                if length >= n:
                    found.append((i - n + 1, p))
            if length <= before[1] and before[1] >= self.min_match:
                matches.append((i - before[1], i, before[0]))
            before = (state, length)
        if before[1] >= self.min_match:
            end = first + len(ids)
            matches.append((end - before[1], end, before[0]))
        return found, matches

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Spans (first word, end word, template, part covered) of chained matches (first word, end word, state), by template.

        A match goes on the chain with the most words that ends at most max_gap words before it, or overlaps it, and at
        an earlier place of the template. Chains that no later match can reach are closed, so few are open at a time.
        """
        placed = defaultdict(list)
        for a, b, state in matches:
            for t, end in self.places[state]:
                placed[t].append((a, b, end - (b - a)))
        spans = []
        for t, parts in placed.items():
            need = self.min_cover * len(self.lists[t])
            open_: list[list[int]] = []  # first word, end word, end in the template, words
            done: list[list[int]] = []
            for a, b, i in sorted(parts):
                if any(x[1] < a - self.max_gap for x in open_):
                    done += [x for x in open_ if x[1] < a - self.max_gap]
                    open_ = [x for x in open_ if x[1] >= a - self.max_gap]
                best = None
                for x in open_:
                    cut = max(0, x[1] - a, x[2] - i)  # words that the chain has already
                    if cut < b - a and (best is None or x[3] - cut > best[0][3] - best[1]):
                        best = (x, cut)
                if best:
                    x, cut = best
                    x[1], x[2], x[3] = b, i + b - a, x[3] + b - a - cut
                else:
                    open_.append([a, b, i + b - a, b - a])
            spans += [(a, b, t, n / len(self.lists[t])) for a, b, _, n in done + open_ if n >= need]
        return spans

    def scan(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Phrases and covered template spans of a document's word numbers."""
        known = ids >= 0
        if not known.any():
            return [], []
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])))
        found, matches = [], []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= self.least:
                f, m = self.runs(ids[a:b], a)
                found += f
                matches += m
        return found, self.chain(matches) if matches else []


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,end:long,cover:double>>"


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Licence phrases and covered template spans of every document.

    Words are runs of letters, digits and characters beyond ASCII, with A-Z as a-z. n_base counts the places of
    phrases, be they one word or overlap others; first_word and last_word are their smallest and largest start, null if
    there is none. labels holds the phrases' labels and those of spans; a span of words that several templates share
    counts for each of them that it covers enough of. score is 1 for a document with a phrase, else the best span's cover,
    else 0. A null or empty text has no words; repeated rows give repeated rows; ids and other columns don't matter; a
    very long text with thousands of matches is chained in one pass; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            rows = []
            for _, _, data, offsets in chunks(batch.column("text")):
                starts, ends, first = words(data, offsets, PLAIN)
                ids = scanner.word_ids(word_hashes(data, starts, ends, scanner.table, scanner.powers)) if len(starts) else np.empty(0, np.int64)
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    found, spans = scanner.scan(ids[a:b])
                    base = sorted({scanner.labels[p] for _, p in found})
                    own = {scanner.labels[t] for _, _, t, _ in spans}
                    at = [i for i, _ in found]
                    score = 1.0 if found else min(1.0, max((c for *_, c in spans), default=0.0))
                    rows.append((b - a, len(found), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *own})), score, [{"label": scanner.labels[t], "first": x, "end": y, "cover": c} for x, y, t, c in spans]))
            span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
