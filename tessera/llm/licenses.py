"""License scans: template markup compiled into token automata.

A template is mandatory wording with regions marked `<<optional>>...<</optional>>`
and `<<var N>>`, which stands for up to N words of any kind. It compiles into a
nondeterministic automaton over words; a text is accepted where its words run
through all mandatory wording exactly. An automaton only runs on texts that hold
all words of its mandatory wording, from words that can begin the template, so a
scan costs little beyond splitting words.

Beside the templates, three base phrases are located wherever their words stand
consecutively.

Score: 1 if a template is accepted, 0.5 if there is only a base phrase, else 0.
Nulls and edges: a null or empty text has no words, no labels and score 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import add_columns, as_bytes, words

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# The wording of public licenses and their usual notices, by label.
# Wording outside the marked regions is mandatory.
_BSD_1_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: <<optional>>1<</optional>> Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. <<optional>>2<</optional>> Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY <<var 12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var 12>> BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_GNU = """is free software <<optional>>you can<</optional>> redistribute it and/or modify it under the terms of the GNU {name} General Public
License as published by the Free Software Foundation <<optional>>either<</optional>> version {version} of the License"""
_CC = """licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> Creative Commons {name} <<optional>>4.0<</optional>>
<<optional>>3.0<</optional>> <<optional>>International<</optional>> <<optional>>Unported<</optional>> License"""
TEMPLATES = [
    ("mit", "<<optional>>This work is<</optional>> <<optional>>released<</optional>> under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var 6>> and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice <<optional>>(including the next
paragraph)<</optional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL <<var 12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("permission-notice", "Permission is hereby granted free of charge to any person obtaining a copy of <<var 6>> and associated documentation files"),
    ("apache-2.0", "licensed under the Apache License <<optional>>Version<</optional>> 2.0"),
    ("apache-2.0", """you may not use this file except in compliance with the License. You may obtain a copy of the License at
<<optional>>http www.apache.org/licenses/LICENSE-2.0<</optional>> <<optional>>https www.apache.org/licenses/LICENSE-2.0<</optional>> Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("bsd-2-clause", f"{_BSD_1_2} {_BSD_END}"),
    ("bsd-3-clause", f"""{_BSD_1_2} <<optional>>3<</optional>> Neither the name of <<var 12>> nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission. {_BSD_END}"""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""),
    ("gpl-2.0", _GNU.format(name="", version=2)),
    ("gpl-3.0", _GNU.format(name="", version=3)),
    ("gpl-3.0", "licensed under the <<optional>>GNU<</optional>> General Public License <<optional>>as published by the Free Software Foundation either<</optional>> version 3"),
    ("lgpl-2.1", _GNU.format(name="Lesser", version="2.1")),
    ("lgpl-3.0", _GNU.format(name="Lesser", version=3)),
    ("agpl-3.0", _GNU.format(name="Affero", version=3)),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at <<optional>>http<</optional>> <<optional>>https<</optional>> mozilla.org/MPL/2.0"""),
    ("cc-by", _CC.format(name="Attribution")),
    ("cc-by-sa", _CC.format(name="Attribution-ShareAlike")),
    ("cc-by-nd", _CC.format(name="Attribution-NoDerivatives")),
    ("cc-by-nc", _CC.format(name="Attribution-NonCommercial")),
    ("cc-by-nc", "licensed under <<optional>>the<</optional>> <<optional>>Creative Commons<</optional>> CC BY-NC <<optional>>4.0<</optional>>"),
    ("cc-by-nc-sa", _CC.format(name="Attribution-NonCommercial-ShareAlike")),
    ("cc-by-nc-nd", _CC.format(name="Attribution-NonCommercial-NoDerivatives")),
    ("cc-by-sa", "licensed under <<optional>>the<</optional>> <<optional>>Creative Commons<</optional>> CC BY-SA <<optional>>4.0<</optional>>"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""),
    ("all-rights-reserved", "<<optional>>Copyright <<var 6>><</optional>> All rights reserved"),
]


class Automaton:
    """Edges by state: words to the states they lead to, a state list reachable free of words, and any-word edges."""

    def __init__(self, template: str):
        self.on: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.free: list[list[int]] = [[]]
        self.needed: set[bytes] = set()  # the words that every accepted text has
        at, opened = 0, []
        for mark in re.findall(r"<<.*?>>|[^<]+", template):
            if mark == "<<optional>>":
                opened.append(at)
            elif mark == "<</optional>>":
                self.free[opened.pop()].append(at)
            elif m := re.fullmatch(r"<<var (\d+)>>", mark):
                start, steps = at, []
                for _ in range(int(m[1])):
                    steps.append(at)
                    self.any[at] = self._state()
                    at = self.any[at]
                for s in (start, *steps):
                    self.free[s].append(at)
            else:
                for w in words(mark.encode()):
                    if not opened:
                        self.needed.add(w)
                    self.on[at][w] = self._state()
                    at = self.on[at][w]
        self.final = at
        self.start = self._closed({0})
        self.first = {w for s in self.start for w in self.on[s]}

    def _state(self) -> int:
        self.on.append({})
        self.any.append(None)
        self.free.append([])
        return len(self.on) - 1

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def accepts_at(self, text: list[bytes], i: int) -> bool:
        states = self.start
        while states:
            if self.final in states:
                return True
            if i == len(text):
                return False
            w = text[i]
            step = {self.on[s][w] for s in states if w in self.on[s]} | {self.any[s] for s in states if self.any[s] is not None}
            states = self._closed(step)
            i += 1
        return False


@cache
def automata() -> list[tuple[str, Automaton]]:
    return [(label, Automaton(t)) for label, t in TEMPLATES]


_PHRASES = {tuple(words(p.encode())): label for p, label in BASE.items()}


def _places(text: list[bytes], word: bytes) -> Iterator[int]:
    i = -1
    while True:
        try:
            i = text.index(word, i + 1)
        except ValueError:
            return
        yield i


def scan(text: bytes | None) -> tuple[int, list[tuple[int, str]], list[str]]:
    """Number of words, base places (first word, label) in order, and labels of accepted templates."""
    w = words(text)
    there = set(w)
    places, labels = [], set()
    for phrase, label in _PHRASES.items():
        if there.issuperset(phrase):
            places += [(i, label) for i in _places(w, phrase[0]) if tuple(w[i : i + len(phrase)]) == phrase]
    for label, a in automata():
        if label not in labels and a.needed <= there and any(a.accepts_at(w, i) for first in a.first & there for i in _places(w, first)):
            labels.add(label)
    return len(w), sorted(places), sorted(labels)


_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("base_places", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType())]))),
    T.StructField("templates", T.ArrayType(T.StringType())),
]


def scan_documents(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_words, base_places (word, label) and templates (labels of accepted ones)."""

    def kernel(x: dict[str, pa.Array]) -> dict[str, object]:
        n, places, labels = zip(*map(scan, as_bytes(x[text_col])), strict=True)
        return {"n_words": n, "base_places": [[{"word": i, "label": b} for i, b in p] for p in places], "templates": labels}

    return add_columns(docs, [text_col], _FIELDS, kernel, keep)


def report(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: base places, labels of base and method, score."""
    found = scan_documents(docs, keep=[id_col])
    base = F.array_sort(F.array_distinct("base_places.label"))
    word = F.col("base_places.word")
    return found.select(
        id_col,
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("templates"))), ",").alias("labels"),
        F.when(F.size("templates") > 0, 1.0).when(F.size("base_places") > 0, 0.5).otherwise(0.0).alias("score"),
    )
