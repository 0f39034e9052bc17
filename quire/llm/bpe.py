"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens; it accepts exactly the token sequences that applying the merges in
order can end in. It starts as one state with an arc for every byte. Each merge ``(a, b)`` adds
one gadget: all arcs ``a`` go to a copy of their target that lacks the arc ``b``, and every
state that has an arc ``a`` gets an arc ``ab`` to where ``b`` led. So each token has one target
state, and that state differs from the target of the token's right half, as it was when the
token was born, only by the arcs that later gadgets took away. This difference is all that is
stored: ``left``, ``right``, ``born`` for each token and ``lost`` for each arc taken away.

A word is encoded by walking the automaton along its bytes; a table of arcs, filled as words
need them, drives it.
The work is linear in the word, also for words of many thousand bytes.
"""

from __future__ import annotations

import json
import pickle
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm.base import added, give_back, numbered, pick

#: Fixed value: the byte-level pre-split pattern; {L} letter, {N} number, {O} neither these nor white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{O}+|\s+(?!\S)|\s+"
#: A worker's tables of words and arcs hold so many at most. A full table of words takes no more, as frequent words
#: come first, but is emptied after twice as many unknown ones; a full table of arcs is emptied at once.
MAX_WORDS, MAX_ARCS = 160_000, 160_000
START = -1
#: Where a node of the byte trie that goes on keeps its token.
TOKEN = -1


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary (a fixed rule of the format)."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


class Automaton:
    """Deterministic automaton over tokens, compiled from merges in their order."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], first: list[int], special: dict[str, int]) -> None:
        """``merges``: (a, b, ab) ids in order; ``first``: ids of the 256 bytes."""
        self.labels, self.special, self.size = labels, special, [len(b) for b in labels]
        n = len(labels)
        self.left, self.right, self.born = [START] * n, [START] * n, [START] * n
        self.lost: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        live = set(first)
        for rank, (a, b, ab) in enumerate(merges):
            if ab in live:
                raise ValueError(f"token {ab} comes from two merges")
            if a in live and b in live and self._arc(a, b):
                self.left[ab], self.right[ab], self.born[ab] = a, b, rank
                self.lost[a << 32 | b] = rank
                live.add(ab)
        self.live = sorted(live)
        self.longest = max(self.size)
        self.root: dict[int, dict | int] = {}

    def trie(self) -> dict[int, dict | int]:
        """The byte trie of all live tokens: nested tables by byte, the token itself under TOKEN or, where nothing goes on, alone.

        Made when a word is first encoded; decoding does without.
        """
        if self.root:
            return self.root
        for t in self.live:
            node, label = self.root, self.labels[t]
            for byte in label[:-1]:
                on = node.get(byte)
                if not isinstance(on, dict):
                    on = node[byte] = {} if on is None else {TOKEN: on}
                node = on
            if isinstance(on := node.get(label[-1]), dict):
                on[TOKEN] = t
            else:
                node[label[-1]] = t
        return self.root

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("root", "arcs")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, arcs={}, root={})

    def _arc(self, p: int, x: int) -> bool:
        """Whether the state after token ``p`` has an arc ``x``, by the history of its gadgets."""
        at = sys.maxsize  # the state is looked at before the gadget of this rank
        while True:
            if self.lost.get(p << 32 | x, sys.maxsize) < at:
                return False
            bp, bx = self.born[p], self.born[x]
            if bp < 0 and bx < 0:
                return True
            if bx >= bp:
                a = self.left[x]
                if a == p and self.right[x] == p:
                    return False  # the copy lost its arc a before arcs aa were added
                at, x = min(at, bx), a
            else:
                at, p = min(at, bp), self.right[p]

    def encode(self, word: bytes) -> list[int]:
        """The only token sequence of a word that the automaton accepts.

        The longest token that has an arc is tried first. All paths to a place of the word end in
        the same token, as the prefix up to there is accepted in one way only, so a place that
        leads nowhere is never tried twice and the search is linear in the word.
        """
        n, arcs, root = len(word), self.arcs, self.root or self.trie()
        path: list[int] = []
        ends: list[int] = []
        tries: list[list[int]] = []  # at each place of the path: tokens left to try, longest last
        dead: set[int] = set()
        at, p = 0, START
        while at < n:
            node, found = root, []
            for byte in word[at : at + self.longest]:
                node = node.get(byte)
                if node is None:
                    break
                if node.__class__ is int:
                    found.append(node)
                    break
                x = node.get(TOKEN)
                if x is not None:
                    found.append(x)
            while True:
                while found:
                    x = found.pop()
                    if p >= 0:
                        ok = arcs.get(p << 32 | x)
                        if ok is None:
                            if len(arcs) >= MAX_ARCS:
                                arcs.clear()
                            ok = arcs[p << 32 | x] = self._arc(p, x)
                        if not ok:
                            continue
                    end = at + self.size[x]
                    if end not in dead:
                        break
                else:
                    # nothing goes on from here: one token back
                    dead.add(at)
                    path.pop()
                    ends.pop()
                    found = tries.pop()
                    at, p = (ends[-1], path[-1]) if path else (0, START)
                    continue
                break
            path.append(x)
            ends.append(end)
            tries.append(found)
            at, p = end, x
        return path

    def decode(self, ids: list[int]) -> str:
        labels, n = self.labels, len(self.labels)
        if ids and not (min(ids) >= 0 and max(ids) < n):
            ids = [i for i in ids if 0 <= i < n]
        return b"".join(map(labels.__getitem__, ids)).decode("utf-8", "replace")


def unlike_library(path: str) -> str:
    """Letters and numbers of newer Unicode versions that the library's splitter does not know as such.

    Only code points that are not assigned in Python's own tables can differ; the splitter itself
    is asked about those.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer
    young = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn")))
    out = []
    for kind, near in ((r"\p{L}+", "a"), (r"\p{N}+", "1")):
        for c in "".join(regex.findall(kind, young)):
            if len(split.pre_tokenize_str(near + c)) > 1:
                out.append(c)
    return "".join(out)


def splitter(unlike: str) -> regex.Pattern:
    """The pre-split pattern; characters in ``unlike`` are neither letters nor numbers."""
    odd = "[" + "".join(f"\\U{ord(c):08x}" for c in unlike) + "]"
    letter, number = (rf"[\p{{{k}}}--{odd}]" if unlike else rf"\p{{{k}}}" for k in "LN")
    other = rf"[[^\s\p{{L}}\p{{N}}]||{odd}]" if unlike else r"[^\s\p{L}\p{N}]"
    return regex.compile(PATTERN.format(L=letter, N=number, O=other), regex.V1 if unlike else 0)


def compile_vocabulary(path: str) -> Automaton:
    """Automaton of a byte-level BPE vocabulary file (JSON)."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    vocab = data["model"]["vocab"]
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    labels = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for piece, i in vocab.items():
        labels[i] = bytes(byte_of[c] for c in piece)
    for piece, i in special.items():
        labels[i] = piece.encode()
    merges = []
    for m in data["model"]["merges"]:
        a, b = m if isinstance(m, list) else m.split(" ")
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    return Automaton(labels, merges, [vocab[c] for c in byte_characters()], special)


class Tokens:
    """A worker's encoder: words met before come from a table, others from the automaton."""

    def __init__(self, automaton: Automaton, unlike: str) -> None:
        self.automaton, self.words = automaton, _Words(automaton)
        self.pattern, self.exact, self.odd = splitter(""), None, frozenset(unlike)
        marks = sorted(automaton.special, key=len, reverse=True)
        self.marks = marks and regex.compile("(" + "|".join(map(regex.escape, marks)) + ")")

    def encode(self, text: str) -> bytes:
        """The ids of a text as packed 32-bit numbers."""
        if not self.marks or not any(m in text for m in self.automaton.special):
            return self._words(text)
        out = []
        for k, part in enumerate(self.marks.split(text)):
            out.append(np.int32(self.automaton.special[part]).tobytes() if k % 2 else self._words(part))
        return b"".join(out)

    def _words(self, text: str) -> bytes:
        pattern = self.pattern
        if not _latin(text) and not self.odd.isdisjoint(text):
            pattern = self.exact = self.exact or splitter("".join(sorted(self.odd)))
        return b"".join(map(self.words.__getitem__, pattern.findall(text)))


def _latin(text: str) -> bool:
    """Whether all characters are below 256, where all versions of the tables agree."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class _Words(dict):
    """The ids of words met before."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton, self.missed = automaton, 0

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.automaton.encode(word.encode())).tobytes()
        if len(self) < MAX_WORDS:
            if len(word) <= 64:
                self[word] = ids
        else:
            self.missed += 1
            if self.missed >= 2 * MAX_WORDS:
                self.clear()
                self.missed = 0
        return ids

    def forget(self) -> None:
        self.clear()
        self.missed = 0
        self.automaton.arcs.clear()


_LOADED: dict[int, Tokens] = {}


def _tokens(packed: bytes) -> Tokens:
    key = hash(packed)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokens(*pickle.loads(packed))
    return _LOADED[key]


def _forget() -> None:
    """Drop this worker's tables. A function of the module, as one made in a call would travel with its own ``_LOADED``."""
    _LOADED.clear()
    give_back()


def _cleared(run):
    """The task ``run``; when it has ended, its worker drops the tables and returns the memory.

    Idle workers live on beside those that later tasks get, and share their executor's memory.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what earlier work in this worker has left
        try:
            yield from run(batches)
        finally:
            _forget()

    return task


def _encoder(packed: bytes, names: list[str], keep_text: bool = False):
    """(text, ...) -> (..., ids), the text before them if it is kept."""

    def run(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokens(packed)
        for batch in texts:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                coded = [own.encode(t or "") for t in part.column(0).to_pylist()]
                ends = np.cumsum([0] + [len(c) // 4 for c in coded]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(coded), np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[0 if keep_text else 1 :], pa.ListArray.from_arrays(ends, flat)], names=names)

    return run


def _decoder(packed: bytes, names: list[str]):
    """(ids, ...) -> (ids, ..., decoded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokens(packed).automaton
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                col = part.column(0)
                ends, flat = col.offsets.to_numpy(), col.values
                if flat.null_count or col.null_count:
                    made = [own.decode([i for i in x if i is not None] if x else []) for x in col.to_pylist()]
                else:
                    flat = flat.to_numpy()[ends[0] : ends[-1]].tolist()
                    ends = (ends - ends[0]).tolist()
                    made = [own.decode(flat[i:j]) for i, j in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.string())], names=names)

    return run


class Tokenizer:
    """A compiled vocabulary, ready for tables: ``encode`` adds ``ids``, ``decode`` adds ``decoded``.

    The compiled tables (a few MB, fixed by the vocabulary) travel with the tasks; no document
    is shuffled. Both keep every row and all columns but those they add (replaced if present).
    """

    def __init__(self, path: str) -> None:
        self.packed = pickle.dumps((compile_vocabulary(path), unlike_library(path)))

    def encode(self, docs: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """Whole texts to arrays of ids; a null text counts as empty and has no ids.

        Strings of special tokens in a text become those tokens, as in the library's default.
        """
        rest = [c for c in docs.columns if c not in (text, ids)]
        schema = added(docs, rest, T.StructField(ids, T.ArrayType(T.IntegerType())))
        return numbered(pick(docs, text, *rest)).mapInArrow(_cleared(_encoder(self.packed, [*rest, ids])), schema)

    def decode(self, coded: DataFrame, ids: str = "ids", text: str = "decoded") -> DataFrame:
        """Arrays of ids to texts; null counts as no ids, ids outside the vocabulary give nothing."""
        rest = [c for c in coded.columns if c not in (text, ids)]
        schema = added(coded, [ids, *rest], T.StructField(text, T.StringType()))
        return numbered(pick(coded, ids, *rest)).mapInArrow(_cleared(_decoder(self.packed, [ids, *rest, text])), schema)

    def encode_and_decode(
        self, docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep_text: bool = False
    ) -> DataFrame:
        """``decode(encode(docs))`` in one Python worker instead of two for each task: half the tables in memory.

        With ``keep_text`` the text stays as a column, without a second copy of it on the way to the worker.
        """
        rest = [c for c in docs.columns if c not in (text, ids, decoded)]
        kept = [text, *rest] if keep_text else rest
        schema = added(docs, kept, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType()))
        there, back = _encoder(self.packed, [*kept, ids], keep_text), _decoder(self.packed, [ids, *kept, decoded])

        def run(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in back(coded.select([ids, *kept]) for coded in there(texts)):
                yield batch.select([*kept, ids, decoded])

        return numbered(pick(docs, text, *rest)).mapInArrow(_cleared(run), schema)
