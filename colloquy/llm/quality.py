"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features are indicators of hashed n-grams: of word shapes up to three, of words
up to two; and of how much of a text each shape makes up. Each indicator is scaled by its class
log-count ratio, then a linear hinge-loss model is fit by dual coordinate
descent and its margins are turned into probabilities by a logistic fit on
rows kept out of it. The model (two vectors of 2^18 floats) is fit on a bounded
sample of labelled rows and scores every document in one pass without shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, words_of

DIMENSIONS = 1 << 18
#: At most so many labelled rows are used to fit the classifier.
SAMPLE_ROWS = 20_000
#: And at most so many indicators in all, so that what the driver holds is bounded.
SAMPLE_SLOTS = 20_000_000
CACHE = 300_000
_SHARES = (0.02, 0.1, 0.3, 0.6)
#: Odd multipliers that keep the kinds of n-grams apart.
_MIX = [(zlib.crc32(f"kind {k}".encode()) << 20 | 1) for k in range(13)]


def _slot(key: str) -> int:
    return zlib.crc32(key.encode()) % DIMENSIONS


def shape(word: str) -> str:
    """Case class of a word and the marks that it ends with, e.g. ``U!!``."""
    core = word.rstrip("!?.,;:*#$%&|-_=~+/\\<>()[]{}\"'")
    marks = word[len(core) :][:4]
    if not core:
        return "P" + marks
    if core.isdigit():
        kind = "D"
    elif not core.isalpha():
        kind = "X"
    elif core.islower():
        kind = "L"
    elif core.isupper() and len(core) > 1:
        kind = "U"
    else:
        kind = "T" if core[1:].islower() or len(core) == 1 else "M"
    return kind + marks


class _Codes(dict):
    """word -> hash of its shape (upper half) and of the word (lower half)."""

    def __missing__(self, word: str) -> int:
        code = self[word] = zlib.crc32(shape(word).encode()) >> 1 << 32 | zlib.crc32(word.encode())
        return code


class Features:
    """Slots of a text's indicators, by one cache look-up per word."""

    def __init__(self) -> None:
        self.codes = _Codes()

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.codes) > CACHE:
            self.codes.clear()
        words = words_of(text)
        n = len(words)
        if not n:
            return np.array([_slot("empty")])
        code = np.fromiter(map(self.codes.__getitem__, words), np.int64, n)
        ordered = np.sort(code)
        new = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        distinct = ordered[new]  # sorted by shape, then word
        shapes = distinct >> 32
        first = np.flatnonzero(np.r_[True, shapes[1:] != shapes[:-1]])
        counts = np.diff(np.r_[new[first], n])
        kinds = shapes[first]
        share = {("same", x) for x in _SHARES if int((code[1:] == code[:-1]).sum()) >= x * n}
        share |= {("new", x) for x in _SHARES if len(distinct) >= x * n}
        s, w = code >> 32, code & 0xFFFFFFFF
        parts = [
            kinds * _MIX[0],
            *[kinds[counts >= x * n] * m for x, m in zip(_SHARES, _MIX[1:], strict=False)],
            s[:-1] * _MIX[5] + s[1:] * _MIX[6],
            s[:-2] * _MIX[7] + s[1:-1] * _MIX[8] + s[2:] * _MIX[9],
            (distinct & 0xFFFFFFFF) * _MIX[10],
            w[:-1] * _MIX[11] + w[1:] * _MIX[12],
        ]
        slots = (np.concatenate(parts) >> 20) & (DIMENSIONS - 1)
        seen = np.zeros(DIMENSIONS, bool) if n > DIMENSIONS // 4 else None
        if seen is not None:
            seen[slots] = True
            slots = np.flatnonzero(seen)
        else:
            slots = np.unique(slots)
        return np.union1d(slots, [_slot(repr(x)) for x in share]) if share else slots


@dataclass
class Model:
    """score = 1 / (1 + exp(-(a * (sum of weights + bias) + b)))"""

    weights: np.ndarray
    bias: float
    a: float
    b: float

    def score(self, slots: np.ndarray) -> float:
        margin = float(self.weights[slots].sum() + self.bias)
        return float(1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a x + b))) by Newton steps, slightly ridged."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    scale = float(np.std(x)) or 1.0
    t, (a, b) = x / scale, (0.0, 0.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * t + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * t).sum() + 0.1 * a, (p - y).sum()])
        h = np.array([[(w * t * t).sum() + 0.1, (w * t).sum()], [(w * t).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - float(np.clip(da, -5, 5)), b - float(np.clip(db, -5, 5))
    return a / scale, b


def fit(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, c: float = 0.05, epochs: int = 12, beta: float = 0.25, seed: int = 7) -> Model:
    """Fits the model to slot lists and 0/1 labels.

    With one class only, or no row at all, every text scores as that class's
    share (0.5 without rows).
    """
    labels = np.asarray(labels, np.int64)
    if len(rows) == 0 or labels.min() == labels.max():
        share = 0.5 if len(rows) == 0 else float(np.clip(labels.mean(), 0.01, 0.99))
        return Model(np.zeros(DIMENSIONS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    counts = np.full((2, DIMENSIONS), alpha)
    for x, y in zip(rows, labels, strict=True):
        counts[y, x] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    ratio = np.log(counts[1] / counts[0])

    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    apart = set(order[: max(1, len(rows) // 5)].tolist()) if len(rows) >= 50 else set()
    train = [i for i in range(len(rows)) if i not in apart]
    scaled = [ratio[x].astype(np.float32) for x in rows]
    w, bias = np.zeros(DIMENSIONS), 0.0
    dual = np.zeros(len(rows))
    square = [float(v @ v) + 1.0 for v in scaled]
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(train).tolist():
            sign = 1.0 if labels[i] else -1.0
            gradient = sign * (float(w[rows[i]] @ scaled[i]) + bias) - 1
            new = min(max(dual[i] - gradient / square[i], 0.0), c)
            if step := new - dual[i]:
                dual[i] = new
                w[rows[i]] += step * sign * scaled[i]
                bias += step * sign
                moved = max(moved, abs(step))
        if moved < 1e-4 * c:
            break
    mean = float(np.abs(w).sum() / max(1, np.count_nonzero(w)))
    weights = ((1 - beta) * mean + beta * w) * ratio if beta < 1 else w * ratio
    check = sorted(apart) or train
    margins = np.array([float(weights[rows[i]].sum() + bias) for i in check])
    a, b = logistic(margins, labels[check])
    return Model(weights.astype(np.float32), bias, a, b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        slots = [features(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([s.astype(np.int32) for s in slots], pa.list_(pa.int32())), batch.column(1), batch.column(2)], ["slots", "label", "place"])


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """text, label and place (a hash) of rows with one of at most ``sample_rows`` labelled ids, those of the lowest hashes.

    ``labels`` has doc_id and label; null labels are left out, and of several
    labels of one id the largest holds. Ids are counted (about) first, so that
    little more than the chosen ones are sorted; these are bounded and
    broadcast, so no document is shuffled.
    """
    place = F.xxhash64("doc_id")
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL")
    ids = known.agg(F.approx_count_distinct("doc_id", 0.02)).first()[0]
    if ids > 2 * sample_rows:
        known = known.where(place < int(-(2.0**63) + 2.0**64 * min(1.0, 1.5 * sample_rows / ids)))
    one = known.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = one.orderBy(place, "doc_id").limit(sample_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", place.alias("place"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits a model to documents (doc_id, text) and labels (doc_id, label)."""
    sample = table(labelled_sample(docs, labels, sample_rows).select("text", "label", "place").mapInArrow(_extract, "slots array<int>, label int, place long"), "slots")
    sizes = sample.groupBy("place").agg(F.sum(F.size("slots")).alias("n")).toArrow().sort_by("place")  # a row per sampled id
    fits = int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()), SAMPLE_SLOTS, "right"))
    if fits < sizes.num_rows:
        sample = sample.where(F.col("place") < sizes["place"][fits].as_py())
    found = sample.select("slots", "label").toArrow()
    rows = [x.values.to_numpy() for x in found["slots"]]
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), rows[i].sum()))  # whatever the tasks' order
    return fit([rows[i] for i in order], np.array([found["label"][i].as_py() for i in order], np.int64))


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, fitted = Features(), model.value
        for batch in batches:
            scores = [fitted.score(features(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row; null texts score as empty ones.

    Repeated rows score alike, ties are equal scores; very long texts are read
    whole; an empty table gives no row; extra columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_scorer(held), "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (all columns) that score at least ``threshold``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, fitted = Features(), held.value
        for batch in batches:
            keep = [fitted.score(features(t)) >= threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
