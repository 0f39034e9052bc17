"""Language identification in two levels: family first, then one-versus-one linear SVMs within it.

Features are hashed character pairs and triples of the whole lower-cased text, every run of
other characters counting as blanks, with logarithmic counts and unit length. Models are
trained here, on a bounded sample of labelled rows; prediction is one pass without a shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.base import added, give_back, numbered, pick

#: Number of features; a power of two.
BITS = 12
SIZE = 1 << BITS
#: At most so many labelled rows are learned from, spread evenly over the languages, each at most PER_LANGUAGE.
SAMPLE_ROWS, PER_LANGUAGE = 4000, 600
#: Language families by ISO 639-1 code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "baltic": ["lt", "lv"], "celtic": ["ga", "cy", "gd", "br"], "hellenic": ["el"],
    "uralic": ["fi", "et", "hu"], "turkic": ["tr", "az", "kk", "uz", "ky", "tk"],
    "indo-aryan": ["hi", "ur", "bn", "mr", "gu", "pa", "ne"], "iranian": ["fa", "ku", "ps", "tg"],
    "semitic": ["ar", "he", "mt", "am"], "dravidian": ["ta", "te", "kn", "ml"], "sinitic": ["zh"], "japonic": ["ja"], "koreanic": ["ko"],
    "austronesian": ["id", "ms", "tl", "jv"], "tai": ["th", "lo"], "austroasiatic": ["vi", "km"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
UNKNOWN = "und"
#: Characters worked on at once in a task.
BLOCK = 2_000_000

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(unit rows of SIZE features, whether the text has a letter)."""
    out, lettered = np.zeros((len(texts), SIZE), np.float32), np.zeros(len(texts), bool)
    letter = _letters()
    for k, text in enumerate(texts):
        for at in range(0, max(len(text), 1), BLOCK):  # two characters of overlap join the blocks
            c = np.frombuffer(text[max(0, at - 2) : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            known = letter[c]
            lettered[k] |= known.any()
            c = np.where(known, c, np.uint32(32))
            c = np.concatenate((np.full(1, 32, np.uint32), c, np.full(1, 32, np.uint32))) if at == 0 else c
            pair = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
            triple = pair[:-1] * np.uint32(0x27D4EB2F) ^ c[2:] * np.uint32(0xC2B2AE3D)
            for h in (pair, triple):
                h ^= h >> np.uint32(15)
                out[k] += np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS), minlength=SIZE)
    np.log1p(out, out=out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out, lettered


def svm(x: np.ndarray, y: np.ndarray, rounds: int = 120, decay: float = 1e-4) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss, classes weighed evenly; y is -1 or 1.

    Accelerated gradient steps of the safe length: rows have unit length, so nothing is tuned.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = last = np.zeros(x.shape[1], np.float32)
    step = np.float32(1 / (4 + decay))
    for k in range(rounds):
        v = w + np.float32(k / (k + 3)) * (w - last)
        slack = np.maximum(0, 1 - y * (x @ v))
        last, w = w, v - step * (np.float32(decay) * v - 2 * (x.T @ (share * y * slack)))
    return w


class Duels:
    """One-versus-one SVMs of some classes; the class with most wins is chosen, then the largest sum of margins."""

    def __init__(self, x: np.ndarray, names: np.ndarray) -> None:
        self.classes = sorted(set(names.tolist()))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        rows = []
        for a, b in self.pairs:
            mine = (names == self.classes[a]) | (names == self.classes[b])
            rows.append(svm(x[mine], np.where(names[mine] == self.classes[a], 1.0, -1.0).astype(np.float32)))
        self.weights = np.array(rows, np.float32).reshape(len(rows), SIZE + 1)

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class number, confidence 0 to 1 of its least certain duel)."""
        n = len(self.classes)
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        wins, total, least = np.zeros((len(x), n)), np.zeros((len(x), n)), np.full((len(x), n), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            m = margin[:, k].astype(float)
            for c, own in ((a, m), (b, -m)):
                wins[:, c] += own > 0
                total[:, c] += own
                least[:, c] = np.minimum(least[:, c], own)
        best = np.argmax(wins + 0.5 * np.tanh(total) / (1 + n), axis=1)
        return best, 1 / (1 + np.exp(-4 * np.clip(least[np.arange(len(x)), best], -50, 50)))


class Model:
    def __init__(self, x: np.ndarray, langs: np.ndarray) -> None:
        family = np.array([FAMILY_OF.get(c, c) for c in langs.tolist()], object)
        self.top = Duels(x, family)
        self.within = {f: Duels(x[family == f], langs[family == f]) for f in self.top.classes}

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        x, lettered = features(texts)
        names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        best, sure = self.top.choose(x)
        for k, f in enumerate(self.top.classes):
            at = np.flatnonzero((best == k) & lettered)
            if len(at):
                own = self.within[f]
                c, s = own.choose(x[at])
                names[at] = np.array(own.classes, object)[c]
                scores[at] = np.minimum(s, sure[at])
        return names.tolist(), scores.tolist()


def held_out():
    """Whether a row is kept for testing; a null doc_id is not, and nothing is learned from it either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS, per_language: int = PER_LANGUAGE) -> Model | None:
    """Model from the rows of ``docs(doc_id, text, lang)`` that are not held out and have text and lang.

    Languages are counted over all rows; the sample takes, of each, the rows with the least hash
    of (doc_id, text), so many as ``sample_rows`` allows all languages evenly. Whole texts become
    features in the tasks; the driver gets the features of the sample only. None without rows.
    """
    rows = pick(docs, "doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each = max(20, min(per_language, sample_rows // len(counts)))
    # a share of each language by hash leaves about twice what is wanted; the rest is cut at the driver
    place = (F.xxhash64("doc_id", "text") / 2.0**64 + 0.5).alias("place")
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(1.0 if n <= 2 * each else 2.0 * each / n)).otherwise(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x, _ = features(part.column(2).to_pylist())
                packed = pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed], names=["lang", "place", "x"])

    found = rows.select("lang", place, "text").filter(F.col("place") < share).mapInArrow(run, "lang string, place double, x binary").toArrow()
    langs, at = np.array(found["lang"].to_pylist(), object), found["place"].to_numpy()
    chosen = np.concatenate([np.flatnonzero(langs == c)[np.argsort(at[langs == c], kind="stable")[:each]] for c in sorted(set(langs.tolist()))])
    x = np.array([np.frombuffer(found["x"][i].as_py(), np.float16) for i in chosen.tolist()], np.float32)
    return Model(x, langs[chosen])


_MODELS: dict[int, Model] = {}


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to every row (replacing such columns), from the text alone.

    A null text or one without a letter is ``und`` with score 0, as is every text if there was
    nothing to learn from. Other columns are kept; rows are independent of each other.
    """
    packed = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(packed)
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = pickle.loads(packed)
        own = _MODELS[key]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(0).to_pylist()]
                langs, scores = own.predict(texts) if own else ([UNKNOWN] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)
        give_back()

    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    names = [*rest, "lang_pred", "score"]
    schema = added(docs, rest, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()))
    return numbered(pick(docs, text, *rest)).mapInArrow(run, schema)
