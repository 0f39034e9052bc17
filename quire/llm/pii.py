"""Personal data: patterns for protected entities, and corpus statistics for terms that give them away.

Entities (mail and IP addresses, card and phone numbers) are found by fixed patterns. A term
discloses an entity to the degree that seeing the term makes the entity likely: with document
frequencies over the whole corpus, ``PMI(e, t) = ln(N * n(e, t) / (n(e) * n(t)))`` against the
entity's own information ``IC(e) = ln(N / n(e))``. A term with ``PMI >= share * IC`` is replaced by
its general form (number, code, name or word) if that form stays below the threshold, else removed,
wherever it stands and in every document, with the entity or without.

Pairs are counted by document. As ``n(e, t) <= n(e)``, the threshold can only be reached where
``n(t) <= n(e) * (N / n(e)) ** (1 - share)``: terms beyond that bound never meet their entities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.base import Scratch, give_back, numbered, pick, whole

#: The kinds in their order, and the characters of their patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Both number patterns can match only inside such a stretch.
DIGITS = re.compile(r"[0-9](?:[0-9.\x20-]*[0-9])?")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A term is a word of three or more letters or digits.
TERM = r"[\p{L}\p{N}]{3,}"
TERMS = regex.compile(TERM)
#: A pair counts from so many documents on; a term may tell so much of the entity's information.
MIN_SUPPORT, SHARE = 3, 0.75
#: General forms of a term, the first that fits; and how a text shows that it holds a term of that form.
FORMS = (("number", r"^\p{N}+$"), ("code", r"\p{N}"), ("name", r"^\p{Lu}"), ("word", r""))
EDGE, END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
HOLDS = {
    "number": EDGE + r"\p{N}{3,}" + END, "code": EDGE + r"(?=[\p{L}\p{N}]{3})(?:\p{N}+\p{L}|\p{L}+\p{N})",
    "name": EDGE + r"\p{Lu}\p{L}{2,}" + END, "word": EDGE + r"(?!\p{Lu})\p{L}{3,}" + END,
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def entities(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; leftmost non-overlapping matches of each kind.

    The mail pattern is walked from its ``@``: its local part is the run of local characters
    before it, so no other start needs trying and the walk is linear in the text.
    """
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((0, start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    ips, cards = [], []
    for run in DIGITS.finditer(text):
        a, b = run.span()
        if b - a >= 7:
            for m in IP.finditer(text, a, b):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    ips.append((1, *m.span()))
        if b - a >= 16:
            for m in CARD.finditer(text, a, b):
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    cards.append((2, *m.span()))
    phones = []
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                phones.append((3, *m.span()))
    return out + ips + cards + phones


def outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end): the terms of a text that touch none of its entities, in their order."""
    taken = sorted((a, b) for _, a, b in spans)
    at, done = 0, 0  # done: where the entities that begin before the term end
    for m in TERMS.finditer(text):
        s, e = m.span()
        while at < len(taken) and taken[at][0] < e:
            done = max(done, taken[at][1])
            at += 1
        if s >= done:
            yield m[0], s, e


def identity(text: str, kind: int, start: int, end: int) -> int:
    """64 bits that stand for an entity, however it is written."""
    value = text[start:end].lower() if kind < 2 else "".join(c for c in text[start:end] if c in "0123456789")
    return xxhash.xxh64_intdigest(f"{kind}:{value}") - 2**63


MENTIONED = "who array<long>, words array<string>"
BASE = "array<struct<kind:int,start:int,end:int>>"
TOLD = "array<struct<start:int,end:int,form:string>>"


def _mentioned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (entities, terms) of the texts that hold entities, each once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            who, words = [], []
            for text in batch.column(0).slice(at, 256).to_pylist():
                spans = entities(text or "")
                if spans:
                    who.append(sorted({identity(text, *s) for s in spans}))
                    words.append(sorted({w for w, _, _ in outside(text, spans)}))
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.string()))], names=["who", "words"])
    give_back()


def _located(keep_text: bool):
    """(text, doc_id, disclosing terms or null) -> (doc_id, text, base, terms)."""
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    told = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("form", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                base, terms = [], []
                for text, hits in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                    spans = entities(text or "")
                    base.append([dict(zip(("kind", "start", "end"), s)) for s in spans])
                    forms = {h["term"]: h["form"] for h in hits or ()}
                    terms.append([{"start": a, "end": b, "form": forms[w]} for w, a, b in outside(text, spans) if w in forms] if forms else [])
                kept = part.column(0) if keep_text else pa.nulls(part.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([part.column(1), kept, pa.array(base, span), pa.array(terms, told)], names=["doc_id", "text", "base", "terms"])
        give_back()

    return run


def form(term: Column) -> Column:
    """Name of a term's general form."""
    out = F.when(term.rlike(FORMS[0][1]), FORMS[0][0])
    for name, rule in FORMS[1:]:
        out = out.when(term.rlike(rule), name)
    return out


def _forms(words: Column) -> Column:
    """Keys of the general forms that a list of terms has."""
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(F.concat(F.lit("#"), form(w)))))


def disclosing_terms(docs: DataFrame, scratch: Scratch, min_support: int = MIN_SUPPORT, share: float = SHARE) -> DataFrame:
    """(t, blocked): keys of the terms of ``docs(text)`` that disclose an entity, with the general forms that disclose it too."""
    total = float(docs.count())
    found = docs.select("text").mapInArrow(_mentioned, MENTIONED).select(F.monotonically_increasing_id().alias("id"), "who", "words")
    found = scratch.write(found, "mentioned")
    of_entity = found.select(F.explode("who").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= min_support)
    bound = F.col("n_e") * F.pow(F.lit(total) / F.col("n_e"), F.lit(1 - share)) * (1 + 1e-9)
    of_entity = scratch.write(of_entity.withColumn("bound", bound), "entities")
    ceiling = of_entity.agg(F.max("bound").alias("top")).first()["top"] or 0.0

    # document frequencies of the terms and forms of the whole corpus, as far as any entity can be told by them
    words = F.regexp_extract_all(whole(), F.lit(TERM), 0)
    forms = F.array(*[F.when(whole().rlike(rule), F.xxhash64(F.lit(f"#{name}"))) for name, rule in HOLDS.items()])
    terms = docs.select(F.explode(F.array_distinct(F.concat(F.transform(words, lambda w: F.xxhash64(F.lower(w))), forms))).alias("t"))
    of_term = terms.filter("t IS NOT NULL").groupBy("t").agg(F.count("*").alias("n_t")).filter(F.col("n_t").between(min_support, ceiling))

    # a document's entities meet those of its terms that are rare enough to tell of them
    own = scratch.write(found.select("id", F.explode("who").alias("entity")).join(of_entity, "entity"), "own-entities")
    keys = F.array_distinct(F.concat(F.transform("words", lambda w: F.xxhash64(F.lower(w))), _forms(F.col("words"))))
    held = found.join(own.select("id").distinct(), "id", "left_semi").select("id", F.explode(keys).alias("t")).join(of_term, "t")
    pairs = held.join(own, "id").filter(F.col("n_t") <= F.col("bound")).groupBy("entity", "t").agg(
        F.count("*").alias("n_et"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e")
    )
    known = F.log(F.lit(total) * F.col("n_et") / (F.col("n_e") * F.greatest("n_t", "n_et")))
    told = pairs.filter((F.col("n_et") >= min_support) & (known >= share * F.log(F.lit(total) / F.col("n_e")) - 1e-12))
    named = F.lit(None).cast("string")
    for name, _ in FORMS:
        named = F.when(F.col("t") == F.xxhash64(F.lit(f"#{name}")), F.lit(name)).otherwise(named)
    told = scratch.write(told.select("entity", "t", named.alias("form")), "told")
    open_ = told.filter("form IS NOT NULL").select("entity", F.col("form").alias("blocked"))
    return scratch.write(told.filter("form IS NULL").select("entity", "t").join(open_, "entity", "left").groupBy("t").agg(F.collect_set("blocked").alias("blocked")), "disclosing")


def find_disclosures(docs: DataFrame, *, keep_text: bool = False, min_support: int = MIN_SUPPORT, share: float = SHARE) -> DataFrame:
    """(doc_id, text, base, terms) for every row of ``docs(doc_id, text)``.

    ``base`` lists the entities, ``terms`` every place of a disclosing term outside entities as
    (start, end, form), the form being null where the term is to be removed. ``text`` is null
    unless ``keep_text``. A pair of entity and term is evidence from ``min_support`` documents on.

    A null or empty text has none of both; doc_ids are carried only, so null or repeated ones are no
    matter (repeated rows count as documents of their own). Texts of any length are read whole. Ties
    with the threshold disclose. An empty table gives no rows, and other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    own = pick(docs, "doc_id", "text")
    disclosing = disclosing_terms(own, scratch, min_support, share)
    marks = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    # a text is known by two hashes, so copies share their terms; never broadcast, as the terms grow with the documents: texts move once at every size
    used = own.select(*marks, F.explode(F.array_distinct(F.regexp_extract_all(whole(), F.lit(TERM), 0))).alias("term"))
    used = used.withColumn("t", F.xxhash64(F.lower("term"))).join(disclosing, "t")
    used = used.select("h1", "h2", "term", F.when(~F.array_contains("blocked", form(F.col("term"))), form(F.col("term"))).alias("form"))
    hits = scratch.write(used.groupBy("h1", "h2").agg(F.collect_set(F.struct("term", "form")).alias("hits")), "hits")
    rows = own.select("text", "doc_id", *marks).join(hits.hint("merge"), ["h1", "h2"], "left").select("text", "doc_id", "hits")
    schema = T.StructType([own.schema["doc_id"], T.StructField("text", T.StringType()), *T._parse_datatype_string(f"base {BASE}, terms {TOLD}").fields])
    return numbered(rows).mapInArrow(_located(keep_text), schema)


def sanitised(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, text, n_spans): texts with entities and disclosing terms generalised or removed.

    An entity becomes ``<email>`` and so on, a term its general form or nothing. Of spans that
    overlap, the earliest holds, of those the longest. Rows without text get an empty one.
    """
    found = find_disclosures(docs, keep_text=True, **settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, base, terms in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                spans = [(s["start"], -s["end"], f"<{KINDS[s['kind']]}>") for s in base]
                spans += [(s["start"], -s["end"], f"<{s['form']}>" if s["form"] else "") for s in terms]
                out, at, n = [], 0, 0
                for start, end, put in sorted(spans):
                    if start >= at:
                        out += [text[at:start], put]
                        at, n = -end, n + 1
                texts.append("".join(out) + (text or "")[at:])
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "text", "n_spans"])

    schema = T.StructType([found.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("n_spans", T.LongType())])
    return found.select("doc_id", "text", "base", "terms").mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the entities' places, and all places as text."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    place = lambda name, s: F.concat(name, F.lit(":"), s["start"], F.lit(":"), s["end"])
    base = F.transform("base", lambda s: place(F.element_at(kind, s["kind"] + 1), s))
    term = F.transform("terms", lambda s: place(F.lit("term"), s))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(F.encode(F.array_join(base, ","), "UTF-8"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, term), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
    )
