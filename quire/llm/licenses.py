"""License scan: templates with optional and replaceable regions as token automata.

A template is licence wording in the public markup style: ``<<opt>> ... <</opt>>`` may be absent,
``<<var:N>>`` stands for up to N words of any kind, the rest is mandatory and must stand word for
word. Each template becomes an automaton over words; all of them run together over a text, and
a place is accepted only if the mandatory words follow each other exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm.base import numbered, pick

#: Phrases that give a label wherever their words stand next to each other.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording of well-known licence notices; labels that end in -notice or -text are the scan's own.
TEMPLATES = {
    "mit-notice": "<<opt>>this work is<</opt>> <<opt>>this software is<</opt>> <<opt>>released<</opt>> <<opt>>licensed<</opt>> <<opt>>distributed<</opt>> under the mit license",
    "apache-2.0-notice": "licensed under the apache license version 2.0 <<opt>>the license you may not use this file except in compliance with the license<</opt>>",
    "gpl-3.0-notice": "licensed under the <<opt>>terms of the<</opt>> gnu general public license <<opt>>as published by the free software foundation either<</opt>> version 3",
    "gpl-2.0-notice": "licensed under the <<opt>>terms of the<</opt>> gnu general public license <<opt>>as published by the free software foundation either<</opt>> version 2",
    "lgpl-notice": "licensed under the <<opt>>terms of the<</opt>> gnu lesser general public license version <<var:2>>",
    "cc-by-notice": "licensed under <<opt>>a<</opt>> cc by <<opt>>sa<</opt>> <<var:2>>",
    "cc-by-nc-notice": "licensed under <<opt>>a<</opt>> cc by nc <<opt>>sa<</opt>> <<opt>>nd<</opt>> <<var:2>>",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
    "copies of the software <<opt>>and to permit persons to whom the software is furnished to do so<</opt>> subject to the following conditions",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
    "copyright notice and this permission notice appear in all copies",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<var:2>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "apache-2.0-text": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license "
    "<<opt>>you may obtain a copy of the license at <<var:8>><</opt>> unless required by applicable law",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
    "the free software foundation either version <<var:1>> of the license or <<opt>>at your option<</opt>> any later version",
    "all-rights-reserved": "copyright <<opt>>c<</opt>> <<var:6>> all rights reserved",
}

#: ASCII bytes that are not part of a word become blanks, A-Z become a-z; other bytes stay.
FOLD = bytes(32 if (b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F) else b for b in range(256))
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else FOLD[b] for b in range(256))
MARK = re.compile(r"<<(opt|/opt|var:\d+)>>|([^<>]+)")


def words(text: str | None) -> list[bytes]:
    """The words of a text: runs of ASCII letters, digits and all other characters beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


class Automaton:
    """All templates as one automaton over words.

    A state has arcs by word, arcs by any word (inside a replaceable region) and free arcs (past
    an optional region). ``closed`` holds each state's arcs after its free arcs were followed.
    """

    def __init__(self, templates: dict[str, str]) -> None:
        self.arcs: list[dict[bytes, set[int]]] = []
        self.any: list[set[int]] = []
        self.free: list[set[int]] = []
        self.label: dict[int, str] = {}
        self.needed: dict[str, frozenset] = {}
        starts = {self._compile(label, wording) for label, wording in templates.items()}
        self.closed = [self._close({s}) for s in range(len(self.arcs))]
        self.start = frozenset().union(*(self.closed[s] for s in starts)) if starts else frozenset()
        self.first = {w for s in self.start for w in self.arcs[s]}
        self.known: dict[tuple[frozenset, bytes], frozenset] = {}

    def _state(self) -> int:
        self.arcs.append({})
        self.any.append(set())
        self.free.append(set())
        return len(self.arcs) - 1

    def _compile(self, label: str, wording: str) -> int:
        start = at = self._state()
        opened, mandatory = [], set()
        for mark, plain in MARK.findall(wording):
            if mark == "opt":
                opened.append(at)
            elif mark == "/opt":
                end = self._state()
                self.free[at].add(end)
                self.free[opened.pop()].add(end)
                at = end
            elif mark:
                end = self._state()
                for _ in range(int(mark.split(":")[1])):
                    self.free[at].add(end)
                    after = self._state()
                    self.any[at].add(after)
                    at = after
                self.free[at].add(end)
                at = end
            else:
                for w in words(plain):
                    after = self._state()
                    self.arcs[at].setdefault(w, set()).add(after)
                    at = after
                    mandatory |= set() if opened else {w}
        self.label[at], self.needed[label] = label, frozenset(mandatory)
        return start

    def _close(self, states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    def step(self, states: frozenset, word: bytes) -> frozenset:
        """The deterministic step, kept once it was needed."""
        key = (states, word)
        if key not in self.known:
            to = set().union(*(self.arcs[s].get(word, ()) for s in states), *(self.any[s] for s in states))
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = frozenset().union(*(self.closed[s] for s in to))
        return self.known[key]

    def scan(self, text: list[bytes]) -> set[str]:
        """Labels of all templates that some place of the text matches.

        Matches that began at different words advance together: the states of all of them form
        one set, which the templates bound, so the scan is linear in the text.
        """
        found, states = set(), frozenset()
        for w in text:
            if w in self.first:
                states = states | self.start
            elif not states:
                continue
            states = self.step(states, w)
            found.update(self.label[s] for s in states if s in self.label)
        return found


def places(text: list[bytes], phrase: tuple[bytes, ...], at: int) -> list[int]:
    """Where the phrase starts, given that its word number ``at`` is the rare one to look for."""
    n, out, pos = len(phrase), [], -1
    while True:
        try:
            pos = text.index(phrase[at], pos + 1)
        except ValueError:
            return out
        if pos >= at and tuple(text[pos - at : pos - at + n]) == phrase:
            out.append(pos - at)


_SCANS: dict[tuple, Automaton] = {}

FIELDS = [
    T.StructField(n, k) for n, k in (
        ("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()),
        ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()),
    )
]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of ``docs(doc_id, text)``.

    Base places are those of the phrases, overlaps included; ``labels`` adds the templates that
    match. The score is 1 with a template's match, 0.5 with phrases only, 0 without any. A null
    text counts as empty; a null or repeated doc_id is carried as it is, as rows are independent.
    No row is shuffled; an empty table gives no rows.
    """
    kinds, named = dict(TEMPLATES if templates is None else templates), dict(PHRASES if phrases is None else phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tuple(kinds.items()), tuple(named.items()))
        if key not in _SCANS:
            _SCANS[key] = Automaton(kinds)
        scan = _SCANS[key]
        phrase = [(tuple(words(p)), label) for p, label in named.items()]
        needed = list(scan.needed.values())
        for batch in batches:
            made = []
            for text in batch.column(1).to_pylist():
                ws = words(text)
                spots, base = [], set()
                have = set(ws)
                for p, label in phrase:
                    if have.issuperset(p):
                        found = places(ws, p, len(p) - 1)
                        spots += found
                        base |= {label} if found else set()
                # a template can match only a text that holds all its mandatory words
                own = scan.scan(ws) if any(map(have.issuperset, needed)) else set()
                made.append((
                    len(ws), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(base)),
                    ",".join(sorted(base | own)), 1.0 if own else 0.5 if base else 0.0,
                ))
            cols = list(zip(*made)) if made else [[] for _ in FIELDS]
            kind = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kind))], names=names)

    own = pick(docs, "doc_id", "text")
    names = ["doc_id", *(f.name for f in FIELDS)]
    return numbered(own).mapInArrow(run, T.StructType([own.schema["doc_id"], *FIELDS]))


def _pattern(wording: str) -> str:
    """The template as a pattern over words that each stand between two blanks."""
    out = []
    for mark, plain in MARK.findall(wording):
        out.append({"opt": "(?:", "/opt": ")?"}.get(mark) or (f"(?: [^ ]+ ){{0,{mark.split(':')[1]}}}" if mark else "".join(f" {w.decode()} " for w in words(plain))))
    return "".join(out)


def licenses_sql() -> str:
    """DuckDB SQL for ``scan_licenses`` with the fixed phrases and templates."""
    spots = " || ".join(
        "[{'at': i, 'label': '" + label + "'} FOR i IN range(len(ws)) IF "
        + " AND ".join(f"ws[i + {k + 1}] = '{w.decode()}'" for k, w in enumerate(words(p))) + "]"
        for p, label in PHRASES.items()
    )
    own = ", ".join(f"CASE WHEN regexp_matches(flat, '{_pattern(w)}') THEN '{label}' END" for label, w in TEMPLATES.items())
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
s AS (SELECT doc_id, ws, {spots} AS spots, ' ' || array_to_string(ws, '  ') || ' ' AS flat FROM w),
l AS (SELECT *, list_sort(list_distinct([x.label FOR x IN spots])) AS base, [x FOR x IN [{own}] IF x IS NOT NULL] AS own FROM s)
SELECT doc_id, len(ws) AS n_words, len(spots) AS n_base, list_min([x.at FOR x IN spots]) AS first_word, list_max([x.at FOR x IN spots]) AS last_word,
  array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(base || own)), ',') AS labels,
  CASE WHEN len(own) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM l
"""
