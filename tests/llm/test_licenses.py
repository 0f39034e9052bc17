"""License scan: automata against patterns, base places against brute force."""

import random
import re

from helpers import clashing, docs

from quire.llm.licenses import PHRASES, TEMPLATES, Automaton, _pattern, scan_licenses, words

TEXTS = [
    "", None, "MIT License, mit-license; MIT\nLICENSE", "mit mit license", "the Apache License", "licensed under the Apache License, Version 2.0.",
    "Released under the MIT License.", "under the gnu general public license", "general public  licensé general public licenseé",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Copyright (c) 2020 Some Name. All rights reserved.", "copyright a b c d e f g h all rights reserved", "x " * 40000 + "mit license",
]


def test_scan(spark):
    out = {r.doc_id: r for r in scan_licenses(clashing(docs(spark, TEXTS))).collect()}
    assert len(out) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        spots = [(k, label) for p, label in PHRASES.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        r = out[i]
        assert (r.n_words, r.n_base) == (len(ws), len(spots))
        assert (r.first_word, r.last_word) == ((min(spots)[0], max(spots)[0]) if spots else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in spots}))
        assert not r.base_labels or set(r.base_labels.split(",")) <= set(r.labels.split(","))
    assert "gpl-text" in out[9].labels and "mit-notice" in out[6].labels and "apache-2.0-notice" in out[5].labels
    assert "all-rights-reserved" in out[10].labels and out[11].labels == "" and out[6].score == 1.0
    assert scan_licenses(docs(spark, [])).count() == 0


def test_automaton_like_patterns():
    rng = random.Random(1)
    kinds = {"a": "x y <<opt>>z <<var:1>> x<</opt>> y", "b": "<<var:2>> z z", "c": "y <<opt>>y<</opt>> <<opt>>x x<</opt>> z", **TEMPLATES}
    scan = Automaton(kinds)
    for _ in range(3000):
        ws = rng.choices([b"x", b"y", b"z"], k=rng.randint(0, 12))
        flat = " " + "  ".join(w.decode() for w in ws) + " "
        assert scan.scan(ws) == {k for k, w in kinds.items() if re.search(_pattern(w), flat)}


def test_words_fold():
    assert words("Ab\x00cÉ1_9[x]") == [b"ab", "cÉ1".encode(), b"9", b"x"]
