"""License scans by templates with optional and replaceable regions.

A template's words must all occur, in order, except inside ``[[...]]`` (may be left out) and ``<<n>>``
(any words, up to n). It is compiled into an automaton over words; a text is accepted where a run
of its words takes the automaton from its start to its end. A template is tried only around places of
its longest mandatory phrase, so most texts are read once by plain phrase search.
"""

from __future__ import annotations

from collections.abc import Iterator
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankspark.llm.rows import map_rows
from bankspark.llm.words import PLAIN_WORDS

# Phrases of the scan contract, and wordings of public licenses.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TEMPLATES = {
    "mit-text": """[[the mit license]] [[mit license]] [[copyright <<12>>]] Permission is hereby granted, free of charge, to any person
        obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
        sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in
        all copies or substantial portions of the Software.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: [[1]] Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. [[2]] Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    "mit-notice": "[[this <<3>> is]] [[released]] [[licensed]] under the [[terms of the]] MIT license",
    "apache-2-notice": "[[this <<3>> is]] licensed under the [[terms of the]] Apache License Version 2 [[0]]",
    "cc-by-nc-notice": "[[this <<3>> is]] licensed under [[a]] [[the]] [[creative commons]] CC BY NC [[<<2>>]]",
    "gpl-3-notice": """[[this <<3>> is]] licensed under the [[terms of the]] GNU General Public License [[as published by the free
        software foundation]] [[either]] version 3""",
    "rights-reserved-notice": "[[copyright <<6>>]] all rights reserved",
}


def plain(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(PLAIN_WORDS).split()


class Template:
    """The automaton of one template: states are places between its parts."""

    def __init__(self, markup: str):
        self.step: list[tuple[bytes, int] | None] = []  # state -> (word, next state)
        self.free: list[list[int]] = []  # state -> states reached without a word
        self.any: set[int] = set()  # states left by any word, to the next state
        runs: list[list[bytes]] = [[]]
        opened: list[int] = []
        self._state()
        for part in re.findall(r"\[\[|\]\]|<<\d+>>|[^\[\]<>]+", markup):
            here = len(self.step) - 1
            if part == "[[":
                opened.append(here)
                self.free[here].append(self._state())
                runs.append([])
            elif part == "]]":
                self.free[here].append(self._state())
                self.free[opened.pop()].append(len(self.step) - 1)
                runs.append([])
            elif part.startswith("<<"):
                for _ in range(int(part[2:-2])):
                    state = len(self.step) - 1
                    self.any.add(state)
                    self.free[state].append(self._state())  # each of the words may be missing
                runs.append([])
            else:
                for word in plain(part):
                    state = len(self.step) - 1
                    self.step[state] = (word, self._state())
                    if not opened:
                        runs[-1].append(word)
        if opened or not any(runs):
            raise ValueError("a template closes its regions and has mandatory words")
        self.anchor = b" %b " % b" ".join(max(runs, key=lambda r: sum(map(len, r))))
        self.most = len(self.step)  # no accepted run has more words
        self.start = self._closed({0})

    def _state(self) -> int:
        self.step.append(None)
        self.free.append([])
        return len(self.step) - 1

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def accepts(self, words: list[bytes]) -> bool:
        """Whether some run of ``words`` is accepted."""
        end, states = len(self.step) - 1, self.start
        for word in words:
            moved = {s + 1 for s in states if s in self.any}
            moved |= {self.step[s][1] for s in states if self.step[s] and self.step[s][0] == word}
            reached = self._closed(moved) if moved else frozenset()
            if end in reached:
                return True
            states = reached | self.start
        return False

    def found_in(self, spaced: bytes, words: list[bytes]) -> bool:
        """``spaced``: the words with a space before, between and after them."""
        first = after = 0  # words that may belong to a match; overlapping stretches are read once
        for place in _places(spaced, self.anchor):
            if place - self.most > after:
                if self.accepts(words[first:after]):
                    return True
                first = place - self.most
            after = place + self.most
        return self.accepts(words[first:after])


def _places(spaced: bytes, phrase: bytes) -> Iterator[int]:
    """Number of the first word at each place of ``phrase``, counted on from place to place."""
    at, seen, place = spaced.find(phrase), 0, 0
    while at >= 0:
        place += spaced.count(b" ", seen, at)
        yield place
        seen, at = at, spaced.find(phrase, at + 1)


def with_licenses(documents: DataFrame, text: Column, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(row, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    ``n_base`` counts places of ``phrases``, ``first_word`` and ``last_word`` are their smallest and
    largest first word (null without any). ``labels`` adds the names of accepted templates.
    ``score``: 1 for an accepted template, 0.5 for phrases alone, else 0. A null or empty text has
    no words. Each row is handled by itself, with any other columns.
    """

    def make():
        automata = {name: Template(markup) for name, markup in templates.items()}
        sought = [(b" %b " % b" ".join(plain(p)), label) for p, label in phrases.items()]

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            out: list[tuple] = []
            for value in columns[0]:
                words = plain(value.as_py())
                spaced = b" %b " % b" ".join(words)
                places, base = [], set()
                for phrase, label in sought:
                    found = list(_places(spaced, phrase))
                    if found:
                        places += found
                        base.add(label)
                own = {name for name, a in automata.items() if a.found_in(spaced, words)}
                out.append((
                    len(words), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if own else 0.5 if base else 0.0,
                ))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            return [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]

        return work

    return map_rows(
        documents, [text], "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", make
    )


def license_scan(documents: DataFrame) -> DataFrame:
    """One row per document with the columns of ``with_licenses``."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_licenses(rows, F.col("text")).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
