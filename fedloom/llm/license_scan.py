"""Licence scans by a generalised suffix automaton of licence tokens.

The automaton holds every run of consecutive words of the licence notices below, sentences as well as whole licences.
Files are streamed through
it for matching statistics (the longest run of notice words that ends at each word, and by suffix links the
longest that each notice has). Long matches are chained into spans of each notice: in the order of the text
and of the notice, with few words of text beyond the notice's own between them. A notice of which one span
covers enough gives its label. Beside this, fixed phrases give base labels wherever their words stand
consecutively.

Most text can't match: a match of MIN_MATCH words holds MIN_MATCH - 1 word pairs of the notices, so only
runs of such pairs, found on whole arrays of word hashes, are streamed. That leaves no match out.
"""

from __future__ import annotations

import re
from bisect import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textscan import ALNUM, Words, ngrams, text_array
from .textscan import batches as text_batches

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices as their licences word them.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
]
#: Whole licences and file headers, of the notices above by how they begin, and of other sentences as they stand.
WHOLE = [
    ("mit", ["Permission is hereby granted, free of charge", "The above copyright notice and this permission notice", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY"]),
    ("bsd-2-clause", ["Redistribution and use in source", "Redistributions of source code", "Redistributions in binary form", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS"]),
    ("bsd-3-clause", ["Redistribution and use in source", "Redistributions of source code", "Redistributions in binary form", "Neither the name of", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS"]),
    ("isc", [
        "Permission to use, copy, modify, and/or", "provided that the above copyright notice and this permission notice appear in all copies.", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR",
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ]),
    ("apache", ["Licensed under the Apache License", "you may not use this file", "Unless required by applicable law"]),
    ("gpl", ["This program is free software", "This program is distributed in the hope", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."]),
    ("mpl", ["This Source Code Form is subject", "If a copy of the MPL"]),
    ("unlicense", ["This is free and unencumbered", "Anyone is free to copy"]),
]
MIN_MATCH = 4
MIN_COVER = 0.6
#: Between two matches of a chain: so many more words of text than of the notice at most.
MAX_GAP = 8
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))


def templates() -> list[tuple[str, str]]:
    """All notices, and the whole licences behind them."""
    def named(part: str) -> str:
        return next((text for _, text in NOTICES if text.startswith(part)), part)

    return NOTICES + [(label, " ".join(map(named, parts))) for label, parts in WHOLE]


class SuffixAutomaton:
    """Of several word sequences; each state knows an end (sequence, position) of its words."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        for k, seq in enumerate(sequences):
            last = 0
            for i, w in enumerate(seq):
                last = self._extend(last, w)
                self.ends[last].add((k, i))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, nexts: dict[bytes, int], link: int) -> int:
        self.next.append(nexts)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """The state of the words of p and w, cut out of q."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][w], w)
        return new

    def statistics(self, words: list[bytes]):
        """(state, length) of the longest match that ends at each word."""
        s = n = 0
        for w in words:
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if w in self.next[s]:
                s, n = self.next[s][w], n + 1
            else:
                s = n = 0
            yield s, n


class Scanner:
    """The automaton of the notices and the pair filter before it."""

    def __init__(self, notices=None, phrases=None, min_match: int = MIN_MATCH, min_cover: float = MIN_COVER, max_gap: int = MAX_GAP):
        self.notices = [(label, words_of(text.encode())) for label, text in (templates() if notices is None else notices)]
        self.phrases = {tuple(words_of(p.encode())): label for p, label in (PHRASES if phrases is None else phrases).items()}
        self.sentences = len(NOTICES) if notices is None else len(self.notices)  # those behind are whole licences
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap
        self.automaton = SuffixAutomaton([w for _, w in self.notices])
        pairs = [self._hash(w[i : i + 2]) for _, w in self.notices for i in range(len(w) - 1)]
        self.pairs = np.unique(np.array(pairs, np.uint64))
        self.heads = {p: self._hash(list(p[:2])) for p in self.phrases}

    @staticmethod
    def _hash(words: list[bytes]) -> np.uint64:
        w = Words(pa.array([b" ".join(words).decode()]), 0, 1, lower=True, letters=ALNUM)
        return ngrams(w.hashes(), len(words))[0]

    def matches(self, segments: list[tuple[int, list[bytes]]]) -> dict[int, list[tuple[int, int, int]]]:
        """Of each notice the matches of min_match words at least that no word lengthens: (start in the text, start in the notice, words), by text. segments: (start, words)."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        auto = self.automaton
        for start, seg in segments:
            for i, (s, n) in enumerate(auto.statistics(seg)):
                seen: set[tuple[int, int]] = set()
                follow = seg[i + 1] if i + 1 < len(seg) else None
                while n >= self.min_match:
                    for k, end in auto.ends[s] - seen:
                        notice = self.notices[k][1]
                        if end + 1 == len(notice) or notice[end + 1] != follow:
                            found.setdefault(k, []).append((start + i - n + 1, end - n + 1, n))
                    seen |= auto.ends[s]
                    s = auto.link[s]
                    n = auto.length[s]
        return {k: sorted(v) for k, v in found.items()}

    def chained(self, k: int, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The best chains of a notice's matches: (words covered, first word, end in the text), none over another, best first.

        Each next match begins and ends later in text and notice; words in both overlapping matches count once.
        """
        reach = len(self.notices[k][1]) + self.max_gap  # the widest gap
        best: list[tuple[int, int]] = []  # of chains that end with each match: words covered, start (the later the better)
        low = 0
        for j, (a, p, n) in enumerate(matches):
            while matches[low][0] + reach + len(self.notices[k][1]) < a:
                low += 1
            top = (n, a)
            for i in range(low, j):
                a0, p0, n0 = matches[i]
                if a0 < a and p0 < p and a0 + n0 < a + n and p0 + n0 < p + n:
                    gap, skip = a - a0 - n0, p - p0 - n0
                    if gap - skip <= self.max_gap:
                        top = max(top, (best[i][0] + n + min(0, gap, skip), best[i][1]))
            best.append(top)
        chains: list[tuple[int, int, int]] = []
        taken: list[tuple[int, int]] = []
        for words, start, end in sorted(((w, s, matches[j][0] + matches[j][2]) for j, (w, s) in enumerate(best)), key=lambda c: (-c[0], c[2] - c[1], c[1])):
            at = bisect(taken, (start, end))
            if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
                taken.insert(at, (start, end))
                chains.append((words, start, end))
        return chains

    def spans(self, segments: list[tuple[int, list[bytes]]]) -> list[tuple[float, int, int, int]]:
        """(share of the notice's words, notice, first word, end in the text) of each chain."""
        return [(words / len(self.notices[k][1]), k, a, b) for k, found in self.matches(segments).items() for words, a, b in self.chained(k, found)]

    def covered(self, chains: list[tuple[float, int, int, int]]) -> list[tuple[int, int, str]]:
        """(first word, end, label) of the chains that cover their notice well, by start. Of whole licences that stand over each other the best covered one counts."""
        well = [(-share, a - b, a, b, k) for share, k, a, b in chains if share >= self.min_cover]
        found = {(a, b, self.notices[k][0]) for *_, a, b, k in well if k < self.sentences}
        taken: list[tuple[int, int]] = []
        for *_, a, b, k in sorted(x for x in well if x[-1] >= self.sentences):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                found.add((a, b, self.notices[k][0]))
        return sorted(found)

    def scan(self, texts: pa.Array):
        """For each text: words, base places (word, label) and chained spans of notices."""
        least = min(self.min_match, min((len(w) for _, w in self.notices), default=self.min_match))
        for _, _, words in text_batches(texts, lower=True, letters=ALNUM):
            h = words.hashes()
            n_words = np.diff(words.first)
            base: dict[int, list[tuple[int, str]]] = {}
            runs: dict[int, list[tuple[int, int]]] = {}
            if len(h) > 1:
                pair = ngrams(h, 2)
                same = np.ones(len(pair), bool)
                borders = words.first[1:-1] - 1
                same[borders[(borders >= 0) & (borders < len(pair))]] = False
                row_of = lambda at: int(np.searchsorted(words.first, at, side="right")) - 1
                for phrase, label in self.phrases.items():
                    for at in np.flatnonzero((pair == self.heads[phrase]) & same).tolist():
                        r = row_of(at)
                        a = at - int(words.first[r])
                        if at + len(phrase) <= words.first[r + 1] and tuple(self._few(words, at, len(phrase))) == phrase:
                            base.setdefault(r, []).append((a, label))
                place = np.searchsorted(self.pairs, pair)
                place[place == len(self.pairs)] = 0
                hit = (self.pairs[place] == pair) & same if len(self.pairs) else np.zeros(len(pair), bool)
                edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
                begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                keep = stop - begin >= least - 1
                for a, b in zip(begin[keep].tolist(), stop[keep].tolist(), strict=True):
                    runs.setdefault(row_of(a), []).append((a, b + 1))
            for r in range(words.rows):
                segments = [(a - int(words.first[r]), self._few(words, a, b - a)) for a, b in runs.get(r, ())]
                yield int(n_words[r]), base.get(r, []), self.spans(segments) if segments else []

    @staticmethod
    def _few(words: Words, at: int, n: int) -> list[bytes]:
        return [words.data[s:e].tobytes() for s, e in zip(words.start[at : at + n].tolist(), words.end[at : at + n].tolist(), strict=True)]


_OUT = [
    ("n_words", "bigint", pa.int64()), ("n_base", "bigint", pa.int64()), ("first_word", "bigint", pa.int64()), ("last_word", "bigint", pa.int64()),
    ("base_labels", "string", pa.string()), ("labels", "string", pa.string()), ("score", "double", pa.float64()), ("spans", "string", pa.string()),
]


def scan_licenses(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Licence phrases and notices of each text.

    n_words; n_base, first_word and last_word: number, least and largest start of base phrases (null if there
    are none); base_labels; labels, with those of well-covered notices; score: the best coverage of a notice
    by one chain of matches, at least 0.5 where a base phrase stands, else 0; spans: label:start:end (in words,
    ends exclusive) of each chain that covers its notice well, by start. A null text is empty: no words, no
    labels, no spans, score 0. Rows stand for themselves, other columns aren't read. One pass, no shuffle; the
    notices' size is fixed.
    """
    fields = [f for f in df.schema.fields if f.name in keep]
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{n} {t}" for n, t, _ in _OUT)])

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            cols: list[list] = [[] for _ in _OUT]
            for n, base, chains in scanner.scan(text_array(batch.column(len(names)))):
                first = {label for _, label in base}
                whole = scanner.covered(chains)
                more = first | {label for _, _, label in whole}
                starts = [a for a, _ in base]
                score = max([0.5 if base else 0.0, *(c[0] for c in chains)])
                for c, v in zip(cols, (n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(first)), ",".join(sorted(more)), score, ",".join(f"{label}:{a}:{b}" for a, b, label in whole)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + [pa.array(c, t) for c, (_, _, t) in zip(cols, _OUT, strict=True)], names=names + [n for n, *_ in _OUT])

    return df.select(*[f"`{n}`" for n in names], f"`{text}`").mapInArrow(run, schema)
