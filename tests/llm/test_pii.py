"""Personal data: base spans against the plain patterns, terms against brute force."""

import hashlib
import math
import random
import re
from collections import defaultdict

import regex
from helpers import clashing, docs

from quire.llm.pii import KINDS, MIN_SUPPORT, SHARE, digest, entities, find_disclosures, luhn, sanitised

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15)[k]
            if good:
                out.append((k, *m.span()))
    return out


def test_entities_like_patterns():
    rng = random.Random(2)
    parts = ["a@b.c", "@", "x.y@", "-", ".", "1", "12.3.4.5", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-11112", "+1 (2) 345-6789", "+", " ", "é", "\n", "(", "0", "00255", "@a-b.co."]
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 9)))
        assert entities(text) == plain(text), repr(text)


def test_long_texts_are_linear():
    for text in ("1" * 200_000, "a" * 300_000 + "@", "a@" * 100_000, "1 " * 100_000, "+1" + "(" * 300_000, "1." * 100_000):
        entities(text)


def corpus():
    rng = random.Random(4)
    common = ["the", "and", "for", "report", "meeting", "Office", "call", "123456"]
    out = []
    for i in range(60):
        body = rng.choices(common, k=12)
        if i % 3 == 0:
            body += ["write", "Zorblatt", "at", "zed@corp.org", "or", "9931", "today"]
        if i % 5 == 0:
            body += ["ring", "+44 20 7946 0958", "soon", "x9z1"]
        out.append(" ".join(body + rng.choices(common, k=6)))
    return out + ["", None, "no data", out[0]]


def general(word):
    return "number" if word.isnumeric() else "code" if any(c.isnumeric() for c in word) else "name" if word[0].isupper() else "word"


def brute(texts):
    """Spans of the disclosing terms of every text, by counting whole documents."""
    n, n_e, n_t, n_et, words = len(texts), defaultdict(int), defaultdict(int), defaultdict(int), []
    for t in (x or "" for x in texts):
        base, every = entities(t), [(m[0], *m.span()) for m in regex.finditer(r"[\p{L}\p{N}]{3,}", t)]
        free = [w for w in every if not any(w[1] < b and a < w[2] for _, a, b in base)]
        words.append(free)
        named = {(k, t[a:b].lower() if k < 2 else re.sub("[^0-9]", "", t[a:b])) for k, a, b in base}
        for e in named:
            n_e[e] += 1
        for w in {w[0].lower() for w in every} | {"#" + general(w[0]) for w in every}:
            n_t[w] += 1
        for w in {w[0].lower() for w in free} | {"#" + general(w[0]) for w in free}:
            for e in named:
                n_et[e, w] += 1
    told = {p for p, c in n_et.items() if c >= MIN_SUPPORT and math.log(n * c / (n_e[p[0]] * n_t[p[1]])) >= SHARE * math.log(n / n_e[p[0]]) - 1e-12}
    by = defaultdict(set)
    for e, w in told:
        by[w].add(e)
    out = [[(a, b, None if any((e, "#" + general(w)) in told for e in by[w.lower()]) else general(w)) for w, a, b in own if w.lower() in by] for own in words]
    return out, set(by)


def test_terms(spark):
    texts = corpus()
    far = ["Quillon reads " + "and the report " * 20 + "ask ask@far.net"] * 9 + ["call Quillon and the office"]
    texts += far + [f"{t} the {k}" for k, t in enumerate(["QUILLON", "no one"])] + [far[0]]
    want, told = brute(texts)
    assert {"zorblatt", "quillon"} <= told and "the" not in told
    for part in (find_disclosures(clashing(docs(spark, texts))), find_disclosures(docs(spark, texts).coalesce(1))):
        got = {r.doc_id: r for r in part.collect()}
        assert len(got) == len(texts)
        for i in range(len(texts)):
            assert [(s["start"], s["end"], s["form"]) for s in got[i].terms] == want[i], i
            assert [(s["kind"], s["start"], s["end"]) for s in got[i].base] == entities(texts[i] or "")
    alone = texts.index("call Quillon and the office")
    assert want[alone] and not entities(texts[alone])
    out = {r.doc_id: r for r in digest(find_disclosures(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        places = [f"{KINDS[k]}:{a}:{b}" for k, a, b in entities(t or "")]
        assert out[i].spans == ",".join(places + [f"term:{a}:{b}" for a, b, _ in want[i]]) and out[i].n_terms == len(want[i])
        assert out[i].base_sha256 == hashlib.sha256(",".join(places).encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in KINDS] == [sum(p.startswith(f"{k}:") for p in places) for k in KINDS]
    clean = {r.doc_id: r.text for r in sanitised(docs(spark, texts)).collect()}
    assert "zed@corp.org" not in clean[0] and "Zorblatt" not in clean[0] and "<email>" in clean[0] and clean[61] == "" and clean[62] == "no data"
    assert "Quillon" not in clean[alone]


def test_long_text(spark):
    texts = ["Wexley " + "lorem " * 300_000 + f"w@long.org {k}" for k in range(3)] + ["the rest"] * 60
    want, told = brute(texts)
    assert "wexley" in told
    got = {r.doc_id: r for r in find_disclosures(docs(spark, texts)).collect()}
    assert [[(s["start"], s["end"], s["form"]) for s in got[i].terms] for i in range(len(texts))] == want


def test_empty(spark):
    assert digest(find_disclosures(docs(spark, []))).count() == 0
    assert sanitised(docs(spark, [None, "+1 234 567 89"], ids=[None, None])).count() == 2
