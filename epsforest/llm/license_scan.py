"""License scans: template markup compiled to token automata.

A template is mandatory wording with two kinds of markup: ``[[ ... ]]`` is an optional region, ``{{name:a-b}}`` a
replaceable one of a to b words; it may have any length. It is compiled to an automaton over words, and that to a
deterministic table over word ids, filled as texts need it; a place in a text is accepted when the mandatory words stand
there exactly, optional regions are there or not, and replaceable ones have any words. A place is followed only as far as
the wording fits, so a text takes time in proportion to its places and the longest fit. Words are compared by 64-bit hashes.

Words are the runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Beside the templates, plain phrases are
counted at all their places. Defined results: a null or empty text has no words, no labels and score 0; repeated rows
repeat. The whole text is read, whatever its length.

score: 1 if a template is accepted, else 0.5 if a phrase is found, else 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsforest.llm.textscan import ALNUM, LOWER, pieces, rows_of, span_hashes, spans

#: Fixed values of the contract: phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Fixed value: what both texts of this family end in.
BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY {{holder:1-20}} AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{holder:1-20}} BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Label, name and version of the licenses that share one notice.
FREE = [
    ("gpl-2.0", "General", "2"), ("gpl-3.0", "General", "3"), ("lgpl-2.1", "Lesser General", "2.1"), ("lgpl-3.0", "Lesser General", "3"),
    ("agpl-3.0", "Affero General", "3"),
]


def notice(name: str, version: str) -> str:
    """The notice of the free software licenses: terms of ``name``, this version or any later one."""
    return (
        f"free software; you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the "
        f"Free Software Foundation; [[either]] version {version} of the License, or (at your option) any later version"
    )


#: Templates by label. Short mentions, then notices and bodies in their public wording; marks and case do not count.
TEMPLATES = {
    "agpl-3.0": ["gnu affero general public license [[v]] [[version]] 3"],
    "apache-2.0": [
        "apache license [[version]] 2 0",
        "you may not use this file except in compliance with the license [[you may obtain a copy of the license at {{url:1-8}}]]",
    ],
    "apache-2.0-notice": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use {{file:1-6}} except in compliance with the License. You may "
        "obtain a copy of the License at {{url:1-10}} Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted [[provided that the following conditions are met]]"],
    "bsd-2-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: [[1.]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "[[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
        "the documentation and/or other materials provided with the distribution. " + BSD_DISCLAIMER
    ],
    "bsd-3-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: [[1.]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "[[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
        "the documentation and/or other materials provided with the distribution. [[3.]] Neither the name of {{organisation:1-20}} nor the names of "
        "its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        + BSD_DISCLAIMER
    ],
    "cc-by-4.0": ["cc by [[version]] 4 0", "creative commons attribution [[version]] 4 0 [[international]]"],
    "cc-by-nc-4.0": ["cc by nc [[version]] 4 0"],
    "cc-by-nc-sa-4.0": ["cc by nc sa [[version]] 4 0"],
    "cc-by-sa-4.0": ["cc by sa [[version]] 4 0"],
    "copyright": ["copyright [[c]] {{owner:1-8}} all rights reserved"],
    "gpl-2.0": ["gnu general public license [[as published by the free software foundation]] [[either]] [[v]] [[version]] 2"],
    "gpl-3.0": ["gnu general public license [[as published by the free software foundation]] [[either]] [[v]] [[version]] 3"],
    "isc": [
        "Permission to use, copy, modify, and [[/or]] distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND {{author:1-20}} DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{author:1-20}} "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ],
    "lgpl": ["gnu lesser general public license"],
    "mit": ["under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software {{rest:0-12}} without restriction"],
    "mit-body": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{holder:1-20}} "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
    "mpl-2.0": ["mozilla public license [[v]] [[version]] 2 0"],
    "mpl-2.0-notice": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at {{url:1-10}}"
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will {{author:1-20}} be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: [[1.]] The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. [[2.]] Altered source versions must be plainly marked as such, and must not "
        "be misrepresented as being the original software. [[3.]] This notice may not be removed or altered from any source distribution."
    ],
} | {f"{label}-or-later": [notice(name, version)] for label, name, version in FREE}
#: States kept of one automaton's table before it is begun anew.
MOST_STATES = 20_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"\[\[|\]\]|\{\{(\w+):(\d+)-(\d+)\}\}|[^\s\[\]{}]+")


def parse(template: str) -> list:
    """A list of words, ('optional', list) and ('words', least, most)."""
    stack: list[list] = [[]]
    for m in TOKEN.finditer(template):
        if m[0] == "[[":
            stack.append([])
        elif m[0] == "]]":
            if len(stack) < 2:
                raise ValueError(f"unbalanced markup: {template!r}")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif m[1]:
            least, most = int(m[2]), int(m[3])
            if least > most:
                raise ValueError(f"empty range: {m[0]!r}")
            stack[-1].append(("words", least, most))
        else:
            stack[-1].extend(WORD.findall(m[0].lower()))
    if len(stack) > 1:
        raise ValueError(f"unbalanced markup: {template!r}")
    if not stack[0] or not isinstance(stack[0][0], str):
        raise ValueError(f"a template starts with a mandatory word: {template!r}")
    return stack[0]


class Automaton:
    """A non-deterministic automaton over words. ``moves[state]``: (word or None for any, next state); ``free``: moves without a word."""

    def __init__(self, template: str) -> None:
        self.first = parse(template)[0]
        self.moves: list[list[tuple[str | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.end = self._build(parse(template), 0)
        self.closure = [frozenset(self._reach(s)) for s in range(len(self.moves))]

    def _state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def _build(self, parts: list, at: int) -> int:
        for part in parts:
            to = self._state()
            if isinstance(part, str):
                self.moves[at].append((part, to))
            elif part[0] == "optional":
                self.free[self._build(part[1], at)].append(to)
                self.free[at].append(to)
            else:
                for k in range(part[2]):
                    if k >= part[1]:
                        self.free[at].append(to)
                    step = self._state()
                    self.moves[at].append((None, step))
                    at = step
                self.free[at].append(to)
            at = to
        return at

    def _reach(self, state: int) -> set[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def words(self) -> set[str]:
        return {w for moves in self.moves for w, _ in moves if w is not None}

    def seconds(self) -> set[str] | None:
        """The words that may follow the first one; None if any word or no word may."""
        words: set[str] = set()
        for s in (t for state in self.closure[0] for w, to in self.moves[state] if w == self.first for t in self.closure[to]):
            if s == self.end or any(w is None for w, _ in self.moves[s]):
                return None
            words |= {w for w, _ in self.moves[s]}
        return words


class Table:
    """The deterministic form of an automaton over word ids: a state is the set of states that the words read so far can reach.

    ids: word to id from 1; 0 stands for every other word. States are made when a text first leads to them; above ``MOST_STATES``
    the table is begun anew, so that its size is bounded whatever the texts.
    """

    def __init__(self, automaton: Automaton, ids: dict[str, int]) -> None:
        self.automaton = automaton
        self.moves = [[(None if w is None else ids[w], to) for w, to in moves] for moves in automaton.moves]
        self._begin()

    def _begin(self) -> None:
        self.sets: list[frozenset[int]] = []
        self.number: dict[frozenset[int], int] = {}
        self.next: list[dict[int, int]] = []
        self.accepts: list[bool] = []
        self._state(self.automaton.closure[0])

    def _state(self, found: frozenset[int]) -> int:
        if found not in self.number:
            self.number[found] = len(self.sets)
            self.sets.append(found)
            self.next.append({})
            self.accepts.append(self.automaton.end in found)
        return self.number[found]

    def _step(self, state: int, word: int) -> int:
        reached = [to for s in self.sets[state] for w, to in self.moves[s] if w is None or w == word]
        if not reached:
            self.next[state][word] = -1
            return -1
        found = frozenset().union(*(self.automaton.closure[t] for t in reached))
        if len(self.sets) >= MOST_STATES:
            self._begin()
            return self._state(found)
        to = self.next[state][word] = self._state(found)
        return to

    def longest(self, ids: np.ndarray, at: int, stop: int) -> int:
        """The end of the longest accepted run of words that starts at ``at``, or -1."""
        state, best = 0, -1
        for i in range(at, stop):
            word = int(ids[i])
            to = self.next[state].get(word)
            state = self._step(state, word) if to is None else to
            if state < 0:
                break
            if self.accepts[state]:
                best = i + 1
        return best


@cache
def compiled(templates: tuple[tuple[str, str], ...]) -> tuple[dict[str, int], dict[str, list[tuple[str, Table]]]]:
    """Ids of the templates' words, and tables by their first word."""
    automata = [(label, Automaton(t)) for label, t in templates]
    ids = {w: i for i, w in enumerate(sorted(set().union(*(a.words() for _, a in automata))), 1)}
    tables: dict[str, list[tuple[str, Table]]] = {}
    for label, a in automata:
        tables.setdefault(a.first, []).append((label, Table(a, ids)))
    return ids, tables


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return span_hashes(data, *spans(data, np.array([0, len(data)]), ALNUM))


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]) -> None:
        self.phrases = [(_hash_words(p.split()), label) for p, label in phrases.items()]
        flat = tuple((label, t) for label, ts in templates.items() for t in ts)
        ids, self.tables = compiled(flat)
        hashes = _hash_words(list(ids))
        order = np.argsort(hashes)
        self.known, self.ids = np.append(hashes[order], np.uint64(2**64 - 1)), np.append(np.array(list(ids.values()), np.int64)[order], 0)
        # which words may come second after each first one, so that few places are tried
        self.pairs: dict[int, np.ndarray | None] = {}
        self.by_id: dict[int, list[tuple[str, Table]]] = {}
        for word, tables in self.tables.items():
            seconds = [t.automaton.seconds() for _, t in tables]
            self.by_id[ids[word]] = tables
            self.pairs[ids[word]] = None if None in seconds else np.array(sorted(ids[w] for x in seconds for w in x), np.int64)

    def places(self, ids: np.ndarray) -> Iterator[tuple[int, list[tuple[str, Table]]]]:
        follows = np.append(ids[1:], 0)
        for word, seconds in self.pairs.items():
            at = np.flatnonzero(ids == word)
            if seconds is not None:
                at = at[np.isin(follows[at], seconds)]
            for i in at.tolist():
                yield i, self.by_id[word]

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> dict[str, list]:
        low = LOWER[buf]
        starts, ends = spans(low, offs, ALNUM)
        h, row = span_hashes(low, starts, ends), rows_of(starts, offs)
        n = len(offs) - 1
        n_words = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
        begin = np.cumsum(n_words) - n_words
        n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        base: list[set[str]] = [set() for _ in range(n)]
        labels: list[set[str]] = [set() for _ in range(n)]
        regions: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for words, label in self.phrases:
            size = len(words)
            if len(h) < size:
                continue
            ok = h[: len(h) - size + 1] == words[0]
            for k in range(1, size):
                ok &= h[k : len(h) - size + 1 + k] == words[k]
            at = np.flatnonzero(ok)
            at = at[row[at] == row[at + size - 1]]
            np.add.at(n_base, row[at], 1)
            np.minimum.at(first, row[at], at - begin[row[at]])
            np.maximum.at(last, row[at], at - begin[row[at]])
            for r in np.unique(row[at]):
                base[r].add(label)
        at = np.searchsorted(self.known[:-1], h)
        ids = np.where(self.known[at] == h, self.ids[at], 0)
        for i, tables in self.places(ids):
            r = int(row[i])
            lo = int(begin[r])
            for label, table in tables:
                if (end := table.longest(ids, i, lo + int(n_words[r]))) >= 0:
                    labels[r].add(label)
                    regions[r].append((i - lo, end - lo))
        found = n_base > 0
        both = [b | t for b, t in zip(base, labels, strict=True)]
        return {
            "n_words": n_words, "n_base": n_base, "first_word": np.where(found, first, 0), "last_word": np.where(found, last, 0), "found": found,
            "base_labels": [",".join(sorted(b)) for b in base], "labels": [",".join(sorted(b)) for b in both],
            "score": [1.0 if t else 0.5 if b else 0.0 for b, t in zip(base, labels, strict=True)], "regions": regions,
        }


def scanner(phrases: dict[str, str], templates: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Scanner(phrases, templates)
        for batch in batches:
            for row, end, buf, offs in pieces(batch.column(1)):
                x = machine.scan(buf, offs)
                none = ~x["found"]
                regions = pa.array([[f"{a}-{b}" for a, b in sorted(set(r))] for r in x["regions"]], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(x["n_words"].astype(np.int64)), pa.array(x["n_base"]), pa.array(x["first_word"], mask=none), pa.array(x["last_word"], mask=none), pa.array(x["base_labels"]), pa.array(x["labels"]), pa.array(x["score"]), regions],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "regions"],
                )

    return run


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, regions array<string>"


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text); ``regions`` are the distinct accepted word ranges ``start-end``, end excluded, in order."""
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    for t in (t for ts in templates.values() for t in ts):
        parse(t)  # a bad template is refused here, not in a task
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(scanner(phrases, templates), SCHEMA)
