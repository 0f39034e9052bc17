"""The pipeline against a plain version of every stage, each on its own input."""

import random
from collections import Counter, defaultdict

import public_tokenizers
from helpers import docs
from test_partenum import brute
from tokenizers import Tokenizer as Library

import corpus_pipeline as cp
from quire.llm.base import pick


def corpus(spark):
    rng = random.Random(9)
    vocab = {"en": "the and of with house tree river stone walked under bright morning".split(), "fr": "le la de avec maison arbre fleuve pierre sous matin clair".split()}
    texts, langs, sources = [], [], []
    for i in range(240):
        lang = rng.choice(["en", "fr"])
        if texts and rng.random() < 0.3 and texts[-1]:
            w = texts[-1].split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab["en"])
            text, lang = ("  " if rng.random() < 0.5 else " ").join(w), langs[-1]
        else:
            text = " ".join(rng.choices(vocab[lang], k=rng.choice([2, 20, 60, 200])))
        texts.append(text)
        langs.append(lang)
        sources.append(f"s{min(rng.randrange(6), 3)}")
    return docs(spark, texts + [None, "", "12 34", "  "], sources=sources + [None] * 4, langs=langs + [None] * 4)


def plain_rows(df):
    return sorted((tuple(r) for r in df.select(*cp.COLUMNS).collect()), key=repr)


def test_stages(spark, tmp_path):
    table = corpus(spark)
    for k, (name, stage) in enumerate(cp.STAGES):
        before = plain_rows(table) if name != "bpe" else None
        after = stage(spark, table, "")
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert tuple(after.columns) == cp.COLUMNS
            rows = plain_rows(after)
            assert set(rows) <= set(before)
        if name == "language_id":
            assert set(before) - set(rows) == {r for r in before if not any(c.isalpha() for c in r[1] or "")}
        if name == "exact_dedup":
            first = {}
            for r in sorted(before):
                first.setdefault(" ".join(r[1].split()), r)
            assert rows == sorted(first.values(), key=repr)
        if name == "near_dedup":
            groups = brute([r[1] for r in before], [r[0] for r in before], words=5, percent=80)
            assert rows == sorted((r for r in before if r[0] in {i for i, _, c in groups if i == c}), key=repr)
            assert 0 < len(rows) < len(before)
        if name == "source_mix":
            words, times = {r[0]: len(r[1].split()) for r in before}, Counter(r[0] for r in rows)
            source, got = defaultdict(int), defaultdict(int)
            for r in before:
                source[r[3]] += words[r[0]]
                got[r[3]] += words[r[0]] * times[r[0]]
            assert max(times.values()) <= 3 and all(got[s] <= 3 * n for s, n in source.items())
            assert abs(sum(got.values()) - sum(source.values())) <= len(source) * max(words.values()) / 2 + 1
        if name == "bpe":
            library, kept = Library.from_file(public_tokenizers.path(cp.VOCABULARY)), {r[0]: r[1] for r in plain_rows(table)}
            out = after.collect()
            assert Counter(r.doc_id for r in out) == Counter(r[0] for r in plain_rows(table))
            assert all(r.lossless and r.ids == library.encode(kept[r.doc_id], add_special_tokens=False).ids for r in out)
        table = after


def test_odd_tables(spark):
    for texts in ([], [None, None], ["", "a b"]):
        table = docs(spark, texts, langs=[None] * len(texts), sources=[None] * len(texts), ids=[None] * len(texts))
        for _, stage in cp.STAGES[:4]:
            table = spark.createDataFrame(stage(spark, table, "").collect(), pick(table, *cp.COLUMNS).schema)
        assert cp.tokenise(spark, table, "").count() == table.count() == 0 if None in texts or not texts else True


def test_near_dedup_rows_that_share_a_doc_id(spark):
    base = [f"w{i}" for i in range(60)]
    near, texts = " ".join([*base, "more"]), ["clean one of its own", "another clean text here"]
    table = docs(spark, [" ".join(base), near, texts[0], near + " still", texts[1]], ids=[1, None, None, 4, 4])
    got = cp.near_dedup(spark, table, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("1", " ".join(base)), ("4", texts[1]), ("None", texts[0])]


def test_mix_keeps_repeated_rows_apart(spark):
    """Equal rows stand as often as they came, times the epochs; equal ids with other columns keep those."""
    rows = [(1, "one two three", "en", "a", 5)] * 3 + [(1, "one two three", "de", "a", 6), (None, "x y", None, "a", None), (None, "x y", None, "a", None)]
    got = cp.source_mix(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)


def test_texts_reach_the_tokeniser_once(spark):
    """A second copy of the texts, to compare with, took as much memory again on both sides."""
    plan = cp.tokenise(spark, docs(spark, ["a b", None, ""]), "")
    sent = plan._jdf.queryExecution().analyzed().toString().split("MapInArrow")[1].splitlines()[1]
    assert sent.count(" AS ") == 3
    assert {r.doc_id: (r.n_tokens, r.lossless) for r in plan.collect()} == {0: (2, True), 1: (0, True), 2: (0, True)}
