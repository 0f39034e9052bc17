"""Encoding against the library, decoding as exact round trip."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import clashing, docs
from tokenizers import Tokenizer as Library

from quire.llm import bpe
from quire.llm.bpe import Automaton, Tokenizer, compile_vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


def merged(merges, word):
    """Merges applied one after the other, each from left to right."""
    word = list(word)
    for a, b, ab in merges:
        i, out = 0, []
        while i < len(word):
            if word[i : i + 2] == [a, b]:
                out.append(ab)
                i += 2
            else:
                out.append(word[i])
                i += 1
        word = out
    return word


@pytest.mark.parametrize("seed", range(8))
def test_gadgets_on_random_merges(seed):
    rng = random.Random(seed)
    labels, merges = [bytes([b]) for b in range(256)], []
    while len(merges) < 40:
        a, b = (rng.choice([97, 98, *range(256, len(labels))]) for _ in "ab")
        if labels[a] + labels[b] not in labels:
            merges.append((a, b, len(labels)))
            labels.append(labels[a] + labels[b])
    own = Automaton(labels, merges, list(range(256)), {})
    for _ in range(400):
        word = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40)))
        assert own.encode(word) == merged(merges, word)


TEXTS = [
    "", None, " ", "\n\n  a  b\t\r\n", "it's we'll I'D 'tis", "naïve façade Straße Привет мир 你好 مرحبا हिन्दी ١٢٣ ½", "a<|endoftext|>b<|endoftext|>",
    "<|endoftext|", "x" * 5000, "ab" * 3000 + " " * 300 + "!?" * 400, "\x00\x1c\x1d\x85  ​﻿ z", "👍🏽👩‍👩‍👧 \U000323b0\U00010940ab1՘꟎",
    "word " * 20000, "1234567890" * 50,
]


def test_encode_like_library(spark, library):
    rng = random.Random(3)
    odd = [chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(4000)]
    texts = TEXTS + ["".join(rng.choices(odd + list(" 'st"), k=60)) for _ in range(150)]
    own = Tokenizer(PATH)
    out = own.decode(own.encode(clashing(docs(spark, texts)))).collect()
    assert len(out) == len(texts)
    for r in out:
        text = texts[r.doc_id] or ""
        want = library.encode(text, add_special_tokens=False).ids
        assert r.ids == want, repr(text[:80])
        assert r.decoded == library.decode(want, skip_special_tokens=False) == text
    assert own.encode(docs(spark, [])).count() == 0
    at_once = own.encode_and_decode(clashing(docs(spark, texts)))
    assert at_once.columns[-2:] == ["ids", "decoded"]
    assert {r.doc_id: (r.ids, r.decoded) for r in at_once.collect()} == {r.doc_id: (r.ids, r.decoded) for r in out}
    assert own.encode_and_decode(docs(spark, [])).count() == 0


def test_one_accepted_sequence(library):
    own = compile_vocabulary(PATH)
    rng = random.Random(5)
    for _ in range(300):
        word = "".join(rng.choices("aeinrstthou", k=rng.randint(1, 30)))
        ids = library.encode(word, add_special_tokens=False).ids
        assert own.encode(word.encode()) == ids
        assert all(own._arc(a, b) for a, b in zip(ids, ids[1:]))


def test_decode_odd_ids(spark):
    table = spark.createDataFrame([(1, None), (2, []), (3, [50256, 99999, -1, None, 64])], "k long, ids array<int>")
    assert {r.k: r.decoded for r in Tokenizer(PATH).decode(table).collect()} == {1: "", 2: "", 3: "<|endoftext|>a"}


def test_tables_of_a_worker_stay_small(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 300)
    monkeypatch.setattr(bpe, "MAX_ARCS", 200)
    own, rng = bpe.Tokens(compile_vocabulary(PATH), ""), random.Random(7)
    for _ in range(4):  # the second bound is met inside a text
        text = " ".join("".join(rng.choices("aeinrstthou", k=rng.randint(2, 9))) for _ in range(1500)) + " the and"
        assert np.frombuffer(own.encode(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(own.words) <= 300 and len(own.automaton.arcs) <= 200
    own.words.forget()
    assert not own.words and not own.automaton.arcs


def test_tasks_leave_nothing_in_their_worker(spark, monkeypatch):
    """Workers live on: a task drops its tables, and only then returns the memory."""
    tasks, left = [], []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, task, schema: tasks.append(task) or spark.createDataFrame([], schema))
    monkeypatch.setattr(bpe, "give_back", lambda: left.append(len(bpe._LOADED)))
    tokenizer, texts = Tokenizer(PATH), docs(spark, ["x"]).select("text")
    tokenizer.decode(tokenizer.encode(texts))
    tokenizer.encode_and_decode(texts)
    encode, decode, both = tasks
    words = [pa.RecordBatch.from_arrays([pa.array(["some words", None])], names=["text"])]
    coded = list(encode(iter(words)))
    assert left[-1] == len(bpe._LOADED) == 0 and len(left) == 2
    assert list(decode(iter(coded)))[0].column(1).to_pylist() == ["some words", ""]
    assert left[-1] == len(bpe._LOADED) == 0 and len(left) == 4
    assert list(both(iter(words)))[0].column(1).to_pylist() == ["some words", ""]
    assert left[-1] == len(bpe._LOADED) == 0 and len(left) == 6
