"""License scans: templates with optional and replaceable regions, compiled into one automaton over words.

A template is a text in which [[...]] marks wording that may be absent and {{n}} up to n words that may be anything;
all other words are mandatory and must match exactly. All templates form one automaton without empty moves; it is made
deterministic as texts need it, and a text is accepted where a run from one of its words ends a template.

Defined results: null, empty and wordless texts have no words, no places and no labels, and score 0; equal texts give
equal rows, also when repeated; texts are scanned whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from . import runtime
from .decontam import TO_WORDS

# The contract's phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public license notices, as words in lower case.
TEMPLATES = [
    ("mit-notice", "[[this work is]] [[this software is]] [[is]] released under the mit license"),
    ("mit-notice", "licensed under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software [[the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{12}} be liable for any claim damages or other liability]]"),
    ("apache-2.0", "licensed under the apache license version 2 0 [[the license you may not use this file except in compliance with the license]]"),
    ("gpl-3.0", "[[this work is]] licensed under the gnu general public license [[as published by {{6}}]] version 3 [[or any later version]]"),
    ("gpl-notice", "{{6}} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {{2}} of the license or at your option any later version"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] cc by nc 4 0 [[international]] [[license]]"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] creative commons attribution noncommercial 4 0 [[international]] [[public]] license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("gpl-text", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl-notice", "{{6}} is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version {{2}} of the license or at your option any later version"),
    ("agpl-notice", "{{6}} is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version {{2}} of the license or at your option any later version"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 [[if a copy of the mpl was not distributed with this file you can obtain one at {{8}}]]"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "[[3]] neither the name of {{8}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
]


def parse(template: str) -> list:
    """Items in order: a word, ("any", n), or ("optional", items)."""
    stack: list[list] = [[]]
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        if token == "[[":
            stack.append([])
        elif token == "]]":
            group = stack.pop()
            stack[-1].append(("optional", group))
        elif token.startswith("{{"):
            stack[-1].append(("any", int(token[2:-2])))
        else:
            stack[-1].append(token)
    if len(stack) != 1:
        raise ValueError(f"regions not closed: {template[:60]}")
    return stack[0]


class Automaton:
    """States are word places of all templates; a set of them is one state of the deterministic automaton."""

    ANY = None

    def __init__(self, templates: list[tuple[str, str]]):
        self.word: list[bytes | None] = []  # what a state reads
        self.next: list[set[int]] = []  # the states that may follow it
        self.ends: list[str | None] = []  # the label that is accepted after it
        starts: set[int] = set()
        for label, template in templates:
            first, last, empty = self._chain(parse(template))
            if empty:
                raise ValueError(f"{label}: no mandatory word")
            starts |= first
            for s in last:
                self.ends[s] = label
        self.start = frozenset(starts)
        self.vocabulary = {w for w in self.word if w is not self.ANY}
        self.first = {self.word[s] for s in self.start}
        self.moves: dict[tuple[frozenset, bytes | None], tuple[frozenset, frozenset]] = {}

    def _state(self, word: bytes | None) -> int:
        self.word.append(word)
        self.next.append(set())
        self.ends.append(None)
        return len(self.word) - 1

    def _chain(self, items: list) -> tuple[set[int], set[int], bool]:
        """First states, last states, and whether it may be empty."""
        first: set[int] = set()
        last: set[int] = set()
        empty = True
        for item in items:
            if isinstance(item, str):
                s = self._state(item.encode())
                f, e, skip = {s}, {s}, False
            elif item[0] == "optional":
                f, e, _ = self._chain(item[1])
                skip = True
            else:
                own = [self._state(self.ANY) for _ in range(item[1])]
                for a, b in zip(own, own[1:]):
                    self.next[a].add(b)
                f, e, skip = set(own[:1]), set(own), True
            for s in last:
                self.next[s] |= f
            first |= f if empty else set()
            last = last | e if skip else e
            empty = empty and skip
        return first, last, empty

    def move(self, states: frozenset, word: bytes) -> tuple[frozenset, frozenset]:
        """The states after a word, and the labels it accepts."""
        key = (states, word if word in self.vocabulary else self.ANY)
        found = self.moves.get(key)
        if found is None:
            read = [s for s in states if self.word[s] is self.ANY or self.word[s] == word]
            found = frozenset(t for s in read for t in self.next[s]), frozenset(self.ends[s] for s in read if self.ends[s])
            self.moves[key] = found
        return found

    def scan(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """Start, end (exclusive) and label of each place where a template fits: for a start and label the longest."""
        out = []
        everywhere = self.ANY in self.first
        for i in range(len(words)) if everywhere else [i for i, w in enumerate(words) if w in self.first]:
            states, at, longest = self.start, i, {}
            while states and at < len(words):
                states, accepted = self.move(states, words[at])
                at += 1
                for label in accepted:
                    longest[label] = at
            out += [(i, end, label) for label, end in longest.items()]
        return out


def without_leading_gaps(templates: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """A replaceable region at a template's start decides nothing about acceptance; a run begins behind it."""
    return [(label, re.sub(r"^(\{\{\d+\}\}\s*)+", "", t)) for label, t in templates]


@lru_cache(1)
def automaton() -> Automaton:
    """One for each process."""
    return Automaton(without_leading_gaps(TEMPLATES))


def places(words: list[bytes], phrase: str) -> list[int]:
    """Where the phrase's words stand consecutively."""
    joined, needle = b" " + b" ".join(words) + b" ", f" {phrase} ".encode()
    out, at, last, seen = [], joined.find(needle), 0, 0
    while at >= 0:
        seen += joined.count(b" ", last, at)
        last = at
        out.append(seen)
        at = joined.find(needle, at + 1)
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: start, end (words, end exclusive), ... of accepted templates. score: 1 where a template is accepted, 0.5
    where only a base phrase stands, else 0.
    """

    def kernel(texts: list[bytes]) -> dict[str, list]:
        of = automaton()
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for text in texts:
            words = text.translate(TO_WORDS).split()
            base = {label: places(words, phrase) for phrase, label in PHRASES.items()}
            at = sorted(x for p in base.values() for x in p)
            found = of.scan(words)
            labels = {k for k, p in base.items() if p}
            for name, value in (("n_words", len(words)), ("n_base", len(at)), ("first_word", at[0] if at else None), ("last_word", at[-1] if at else None), ("base_labels", ",".join(sorted(labels))), ("labels", ",".join(sorted(labels | {x for *_, x in found}))), ("score", 1.0 if found else 0.5 if at else 0.0), ("spans", [x for a, b, _ in found for x in (a, b)])):
                out[name].append(value)
        return out

    return runtime.map_rows(df, [id_col], text_col, kernel, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<long>")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every whole text of documents."""
    return scan(runtime.table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")


def _regex(items: list) -> str:
    return "".join(f" {x}" if isinstance(x, str) else f"(?:{_regex(x[1])})?" if x[0] == "optional" else f"(?: [^ ]+){{0,{x[1]}}}" for x in items)


def _sql() -> str:
    """Phrases by places in the list of words; templates as regular expressions over the words joined by spaces."""
    base = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: {' and '.join(f"coalesce(w[i + {k}], '') = '{x}'" for k, x in enumerate(p.split()))}) as at_{label}" for p, label in PHRASES.items())
    kinds = sorted({k for k, _ in TEMPLATES})
    name = lambda k: "is_" + re.sub(r"\W", "_", k)
    marks = ", ".join(f"regexp_matches(j, '(?:{'|'.join(_regex(parse(t)) for x, t in without_leading_gaps(TEMPLATES) if x == k)}) ') as {name(k)}" for k in kinds)
    labels = sorted([*((f"len(at_{x}) > 0", x) for x in PHRASES.values()), *((name(k), k) for k in kinds)], key=lambda x: x[1])
    joined = lambda some: f"array_to_string(list_filter([{', '.join(f"case when {c} then '{x}' end" for c, x in some)}], lambda x: x is not null), ',')"
    return f"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents
), p as (select doc_id, len(w) as n, ' ' || array_to_string(w, ' ') || ' ' as j, {base} from d
), m as (select *, list_sort(list_concat(at_mit, at_apache, at_gpl)) as pos, {marks} from p)
select doc_id, cast(n as bigint) as n_words, cast(len(pos) as bigint) as n_base, cast(pos[1] - 1 as bigint) as first_word, cast(pos[len(pos)] - 1 as bigint) as last_word,
  {joined([x for x in labels if x[0].startswith("len")])} as base_labels, {joined(labels)} as labels,
  cast(case when {' or '.join(map(name, kinds))} then 1.0 when len(pos) > 0 then 0.5 else 0.0 end as double) as score
from m
"""


SQL = _sql()
