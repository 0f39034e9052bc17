"""Array work of the repeated-substring operator: cover samples and windows of many documents at once."""

from __future__ import annotations

import numpy as np

from quire.llm.shingles import U, _BYTE, mix, powers

#: Fixed value: a perfect difference set; every residue modulo 73 is a difference of two of its members.
COVER = (0, 1, 3, 7, 15, 31, 36, 54, 63)
PERIOD = 73


class Block:
    """Documents laid out in one buffer, each from a multiple of the period on, with gaps of zeros.

    Positions that are cover members modulo the period are then the samples of every document at
    once, and reading past a document's ends reads zeros.
    """

    def __init__(self, texts: list, length: int) -> None:
        """``texts``: buffers of bytes; ``length``: bytes of the strings that are looked for."""
        self.length, self.before, self.core = length, PERIOD - 1, length - PERIOD + 1
        gap = -(-(length + PERIOD) // PERIOD) + 1
        self.n = np.array([len(t) for t in texts], np.int64)
        cells = self.n // PERIOD + 1 + gap
        self.start = (np.concatenate(([0], np.cumsum(cells)[:-1])) + gap) * PERIOD
        self.cell_doc = np.repeat(np.arange(len(texts)), cells)
        total = (int(cells.sum()) + gap) * PERIOD
        self.raw = np.zeros(total + 8, np.uint8)
        for at, t in zip(self.start.tolist(), texts):
            self.raw[at : at + len(t)] = np.frombuffer(t, np.uint8)
        self.cells = int(cells.sum())
        # the eight bytes at every place as one number
        self.words = np.ndarray((total,), "<u8", self.raw, 0, (1,))

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, position in it, name) of every sample; the name hashes the ``core`` bytes from there on.

        Two equal strings of ``length`` bytes share a sample: at some distance below the period
        from their starts both have a cover position, with equal names.
        """
        # cells are counted from the first document's start on; samples come in the order of places
        base = int(self.start[0]) if len(self.start) else 0
        at = (np.arange(self.cells, dtype=np.int64)[:, None] * PERIOD + (base + np.array(COVER))).ravel()
        doc = np.repeat(self.cell_doc, len(COVER))
        place = at - self.start[doc]
        ok = (place >= 0) & (place + self.core <= self.n[doc]) & (self.n[doc] >= self.length)
        at, place, doc = at[ok], place[ok], doc[ok]
        return doc, place, self._hash(at, 0, self.core, 31)

    def _hash(self, at: np.ndarray, first: int, size: int, salt: int) -> np.ndarray:
        """Hashes of the ``size`` bytes (8 or more) that begin ``first`` bytes after each place."""
        h = np.full(len(at), U(salt), np.uint64)
        for off in [*range(0, size - 8, 8), size - 8]:
            h ^= self.words[at + (first + off)]
            h *= U(0x9E3779B97F4A7C15)
            h ^= h >> U(32)
        return mix(h, salt)

    def contexts(self, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Hash of all bytes that strings through a sample can hold, and of how far the document reaches there."""
        reach = np.minimum(place, self.before) * 1024 + np.minimum(self.n[doc] - place, self.length)
        return mix(self._hash(self.start[doc] + place, -self.before, self.before + self.length, 37) ^ mix(reach.astype(np.uint64), 41))


def windows(raw: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all strings of ``length`` bytes of a document, by start."""
    n = len(raw)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
    return mix((total[length:] - total[: n - length + 1]) * down[: n - length + 1], 43)
