"""Toxic passages: maximal scoring segments over token log-odds.

Each token scores the log-odds of its share of toxic documents, smoothed by a
chain of Dirichlet priors (all tokens, then prefixes of three to five letters,
then the token), less a penalty that makes the expected score of clean text
negative. A linear-time scan finds every maximal scoring segment of a text.
Segments are judged by extreme-value statistics: with the Karlin-Altschul
parameters of clean text, a segment of score S among n tokens is expected
K n exp(-lambda S) times by chance. A logistic fit turns the significance of a
text's segments into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, most_frequent, table, words_of
from .quality import labelled_sample, logistic

#: At most so many labelled rows are used to fit the classifier.
SAMPLE_ROWS = 40_000
#: At most so many tokens and prefixes have scores of their own.
MODEL_KEYS = 400_000
PREFIXES = (3, 4, 5)
#: Segments with a smaller expected number of chance occurrences are reported.
SIGNIFICANT = 0.05
CACHE = 300_000
_MARKS = ".,;:!?\"'()[]{}<>#$%&*|-_=~+/\\«»¿¡…“”‘’"


def token(word: str) -> str:
    """A word without marks around it, A-Z in lower case."""
    return lower_ascii(word.strip(_MARKS))


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) of a score sequence.

    The linear-time method of Ruzzo and Tompa; runs of scores at or below zero
    are passed over at once, as only positive scores begin a candidate.
    """
    total = np.r_[0.0, np.cumsum(scores)]
    positive = np.flatnonzero(scores > 0)
    left: list[float] = []  # cumulative total before each candidate
    right: list[float] = []  # and after it
    span: list[tuple[int, int]] = []
    for i, low, high in zip(positive.tolist(), total[positive].tolist(), total[positive + 1].tolist(), strict=True):
        begin, end = i, i + 1
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j -= 1
            if j < 0 or right[j] >= high:
                left.append(low), right.append(high), span.append((begin, end))
                break
            low, begin = left[j], span[j][0]
            del left[j:], right[j:], span[j:]
    return [(r - x, b, e) for x, r, (b, e) in zip(left, right, span, strict=True)]


@dataclass
class Model:
    """Token scores, extreme-value parameters and the final logistic fit."""

    scores: dict[str, float] = field(default_factory=dict)
    default: float = -1.0
    lam: float = 1.0
    k: float = 0.1
    a: float = 0.0
    b: float = 0.0

    def token_score(self, word: str) -> float:
        t = token(word)
        found = self.scores.get(t)
        if found is None:
            for n in reversed(PREFIXES):
                if len(t) > n and (found := self.scores.get(t[:n] + "\x00")) is not None:
                    break
        return self.default if found is None else found

    def significance(self, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        """Summed significance of a text's segments, and the significant ones with their expectation."""
        n, sum_, found = max(len(scores), 1), 0.0, []
        for s, begin, end in segments(scores):
            expected = self.k * n * math.exp(-min(self.lam * s, 700.0))
            if expected < 1:
                sum_ += -math.log(max(expected, 1e-12))
            if expected < SIGNIFICANT:
                found.append((begin, end, expected))
        return sum_, found

    def probability(self, significance: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a * math.log1p(significance) + self.b))))


class _Scores(dict):
    """word -> its score, kept for a bounded number of words."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE:
            self.clear()
        score = self[word] = self.model.token_score(word)
        return score

    def of(self, words: list[str]) -> np.ndarray:
        """Scores of a text's words; a word right after itself is no new evidence."""
        scores = np.fromiter(map(self.__getitem__, words), np.float64, len(words))
        again = np.fromiter(map(str.__eq__, words[1:], words), bool, max(len(words) - 1, 0))
        scores[1:][again] = np.minimum(scores[1:][again], self.model.default)
        return scores


def token_log_odds(counts: dict[str, tuple[int, int]], toxic: int, clean: int, strength: float = 2.0, penalty: float = 2.0) -> tuple[dict[str, float], float]:
    """Scores of tokens and prefixes (ending in NUL), and that of all others.

    ``counts``: in how many toxic and clean documents each token occurs.
    """
    base = (toxic + 0.5) / (toxic + clean + 1)
    prior = math.log(base / (1 - base))
    sums: dict[str, list[int]] = {}
    for t, (a, b) in counts.items():
        for n in PREFIXES:
            if len(t) > n:
                x = sums.setdefault(t[:n] + "\x00", [0, 0])
                x[0] += a
                x[1] += b
    share: dict[str, float] = {}
    for key in sorted(sums, key=len):
        up = share.get(key[:-2] + "\x00", base)
        a, b = sums[key]
        share[key] = (a + 5 * strength * up) / (a + b + 5 * strength)
    for t, (a, b) in counts.items():
        up = next((share[t[:n] + "\x00"] for n in reversed(PREFIXES) if len(t) > n), base)
        share[t] = (a + strength * up) / (a + b + strength)
    odds = {t: math.log(s / (1 - s)) - prior - penalty for t, s in share.items()}
    kept = sorted(odds.items(), key=lambda x: (-abs(x[1] + penalty), x[0]))[:MODEL_KEYS]
    return dict(kept), -penalty


def karlin_altschul(values: np.ndarray, weights: np.ndarray) -> float:
    """lambda > 0 with mean exp(lambda s) = 1 over the clean score distribution."""
    values, p = np.asarray(values, float), np.asarray(weights, float) / np.sum(weights)
    if values.max() <= 0 or (values * p).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(np.minimum(high * values, 700))).sum() < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * values, 700))).sum() < 1 else (low, mid)
    return max(high, 1e-3)


def unfitted(toxic: int, documents: int) -> Model:
    """A model that scores every text as the share of toxic documents (0.5 without documents)."""
    share = 0.5 if not documents else min(max(toxic / documents, 0.01), 0.99)
    return Model(b=math.log(share / (1 - share)))


def chance(clean: dict[float, int], best: list[tuple[int, float]]) -> tuple[float, float]:
    """lambda and K of clean texts, from counts of token scores and each text's (tokens, best segment score).

    K is such that clean texts have one chance segment of their best score in
    the median.
    """
    lam = karlin_altschul(np.array(list(clean) or [-1.0]), np.array(list(clean.values()) or [1]))
    expected = [n * math.exp(-min(lam * s, 700.0)) for n, s in best if s > 0]
    k = 1 / max(float(np.median(expected)), 1e-9) if expected else 0.1
    return lam, min(max(k, 1e-4), 1.0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, list[int]] = {}
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for t in {token(w) for w in set(words_of(text))}:
                found.setdefault(t, [0, 0])[0 if label else 1] += 1
    names = list(found)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[t][0] for t in names], pa.int64()), pa.array([found[t][1] for t in names], pa.int64())], ["token", "toxic", "clean"])


def _clean_scores(held):
    """Of clean texts: counts of rounded token scores, and each one's tokens and best segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, counts, sizes, best = _Scores(held.value), Counter(), [], []
        for batch in batches:
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
                if not label:
                    scores = look.of(words_of(text))
                    counts.update(np.round(scores, 2).tolist())
                    if len(scores):
                        sizes.append(len(scores))
                        best.append(max((x[0] for x in segments(scores)), default=0.0))
        n = len(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([False] * n + [True] * len(best)), pa.array([*counts, *best], pa.float64()), pa.array([*counts.values(), *sizes], pa.int64())], ["whole", "score", "n"]
        )

    return run


def _significances(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Scores(held.value)
        for batch in batches:
            found = [math.log1p(held.value.significance(look.of(words_of(t)))[0]) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch["label"]], ["x", "label"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits a model to documents (doc_id, text) and labels (doc_id, label).

    Token counts come from four fifths of the sampled texts, by a hash; the
    others calibrate what those counts have scored. Texts stay in tasks: the
    driver gets counts, and a few numbers per calibration row. With one class
    only, every text scores as its share.
    """
    sc = docs.sparkSession.sparkContext
    sample = labelled_sample(docs, labels, sample_rows)
    part = F.pmod(F.xxhash64("text"), F.lit(5))
    counts = sample.where(part != 0).select("text", "label").mapInArrow(_count, "token string, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # tokens of toxic texts come first, then the most frequent ones
    weight = F.col("toxic") * (1 << 20) + F.least("clean", F.lit((1 << 20) - 1))
    top = most_frequent(table(counts.where("toxic + clean > 1").select(F.col("token").alias("unit"), weight.alias("n"), "toxic", "clean"), "toxic-counts"), MODEL_KEYS)
    apart = table(sample.where(part == 0).select("text", "label"), "calibration")
    documents, toxic = apart.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not documents or toxic in (0, documents):
        return unfitted(toxic or 0, documents)
    scores, default = token_log_odds({t: (a, b) for t, a, b in zip(*(top[c].to_pylist() for c in ("unit", "toxic", "clean")), strict=True)}, toxic, documents - toxic)
    model = Model(scores, default)
    found = apart.mapInArrow(_clean_scores(sc.broadcast(model)), "whole boolean, score double, n long").toArrow().to_pylist()
    clean: Counter[float] = Counter()
    for r in found:
        if not r["whole"]:
            clean[r["score"]] += r["n"]
    model.lam, model.k = chance(clean, [(r["n"], r["score"]) for r in found if r["whole"]])
    judged = apart.mapInArrow(_significances(sc.broadcast(model)), "x double, label int").toArrow()
    model.a, model.b = logistic(judged["x"].to_numpy(), judged["label"].to_numpy())
    return model


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        look = _Scores(fitted)
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1).to_pylist():
                sum_, found = fitted.significance(look.of(words_of(text)))
                scores.append(fitted.probability(sum_))
                spans.append([{"start": b, "end": e, "expected": x} for b, e, x in found])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("expected", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "passages"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and significant passages (word spans) of every row.

    Null and empty texts have no segment and score as such a text; repeated
    rows score alike, ties are equal scores; very long texts are scanned whole,
    in linear time; an empty table gives no row; extra columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_scorer(held), "doc_id long, score double, passages array<struct<start:int,end:int,expected:double>>")
