"""Language of texts by a convolutional network over bytes, trained and applied in numpy.

Bytes are embedded; filters of several widths slide over a window of fixed
length; each filter's largest response in the window (ReLU) goes to a softmax
over languages. A text is all its windows, the last one padded; its
probabilities are the windows' means, weighted by their bytes.

An embedded filter is a table from byte to response for each of its places, so
a window is scored by adding rows of tables; places are taken in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 20
EMBEDDING = 8
#: Bytes of a window with the zeros behind it, so that every filter has WINDOW places.
SPAN = WINDOW + max(WIDTHS)
#: Windows that are scored at once.
BATCH = 32
#: Labelled rows that the network is fit on, at most; shared out evenly among languages.
SAMPLE_ROWS = 16_000
#: Languages that are told apart, at most: the most frequent ones.
MOST_LANGUAGES = 256
EPOCHS = 4
UNKNOWN = "und"


@dataclass
class Network:
    """Embedding (256, e), filters of each width (width, e, n), their biases, softmax weights and biases."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """Response of each width's filters to a byte at each of their places."""
        return [[self.embedding @ place for place in f] for f in self.filters]

    @cached_property
    def paired(self) -> list[np.ndarray]:
        """Responses of all filters, side by side, to the two bytes at places 0 and 1, at 2 and 3, and so on; zero beyond a filter's width."""
        steps, none = [], np.zeros((256, FILTERS))
        for at in range(0, max(WIDTHS), 2):
            at_place = lambda t, o: t[o] if o < len(t) else none
            rows = [(at_place(t, at)[:, None, :] + at_place(t, at + 1)[None, :, :]).reshape(65536, FILTERS) for t in self.tables()]
            steps.append(np.ascontiguousarray(np.concatenate(rows, axis=1), np.float32))
        return steps

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each window (n, SPAN), after bias and ReLU."""
        pairs = windows[:, :-1].astype(np.intp) * 256 + windows[:, 1:]
        sums = self.paired[0].take(pairs[:, :WINDOW].ravel(), axis=0)
        for step, table in enumerate(self.paired[1:], 1):
            sums += table.take(pairs[:, 2 * step : 2 * step + WINDOW].ravel(), axis=0)
        return np.maximum(sums.reshape(len(windows), WINDOW, -1).max(axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return _softmax(self.pooled(windows) @ self.out + self.out_bias)

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of each text's languages; zero for an empty text."""
        total = np.zeros((len(texts), len(self.languages)))
        held, owners, sizes = np.zeros((BATCH, SPAN), np.uint8), [], []

        def score() -> None:
            if owners:
                np.add.at(total, owners, self.probabilities(held[: len(owners)]) * np.array(sizes)[:, None])
                owners.clear()
                sizes.clear()

        for k, text in enumerate(texts):
            whole = np.frombuffer(text, np.uint8)
            for at in range(0, len(whole), WINDOW):
                part = whole[at : at + WINDOW]
                row = len(owners)
                held[row, : len(part)] = part
                held[row, len(part) :] = 0
                owners.append(k)
                sizes.append(len(part))
                if len(owners) == BATCH:
                    score()
        score()
        return total / np.maximum(np.array([len(t) for t in texts], float), 1)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(net: Network, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of windows, and its gradients by embedding, each width's filters, bias, out and out_bias.

    Only a filter's largest response is handed back to the bytes below it.
    """
    n = len(windows)
    tables, places, tops = net.tables(), [], []
    for k, w in enumerate(WIDTHS):
        response = sum(tables[k][o][windows[:, o : o + WINDOW]] for o in range(w))
        at = response.argmax(axis=1)
        places.append(at)
        tops.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0])
    before = np.concatenate(tops, axis=1) + net.bias
    hidden = np.maximum(before, 0)
    p = _softmax(hidden @ net.out + net.out_bias)
    loss = float(-np.log(np.maximum(p[np.arange(n), labels], 1e-300)).mean())
    p[np.arange(n), labels] -= 1
    p /= n
    back = (p @ net.out.T) * (before > 0)
    d_embedding, d_filters = np.zeros_like(net.embedding), []
    for k, w in enumerate(WIDTHS):
        mine, d = back[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(net.filters[k])
        for o in range(w):
            seen = np.take_along_axis(windows, places[k] + o, axis=1).astype(np.int64)
            d_table = np.bincount((seen * FILTERS + np.arange(FILTERS)).ravel(), mine.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            d[o] = net.embedding.T @ d_table
            d_embedding += d_table @ net.filters[k][o].T
        d_filters.append(d)
    return loss, [d_embedding, *d_filters, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, batch: int = 64, rate: float = 0.004, seed: int = 7) -> Network:
    """Trains a network by Adam over mini-batches in a seeded order.

    In each batch every other window is cut at a random length, so that short
    texts, whose windows are mostly padding, are learned as well.
    """
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    net = Network(
        languages, rng.normal(0, 0.5, (256, EMBEDDING)), [rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)) for w in WIDTHS],
        np.zeros(total), rng.normal(0, total**-0.5, (total, len(languages))), np.zeros(len(languages)),
    )
    parameters = [net.embedding, *net.filters, net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(x) for x in parameters], [np.zeros_like(x) for x in parameters], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            shown = windows[chosen].copy()
            ends = rng.integers(12, WINDOW, len(chosen))
            ends[::2] = WINDOW
            shown[np.arange(SPAN) >= ends[:, None]] = 0
            _, found = gradients(net, shown, labels[chosen])
            step += 1
            for x, g, a, b in zip(parameters, found, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def _letters(column: str = "text"):
    return F.coalesce(F.col(column).rlike(r"\p{L}"), F.lit(False))


def labelled_sample(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> pa.Table:
    """lang and a window's text of at most ``sample_rows`` rows (text, lang) with a language and a letter.

    Languages are counted first, without reading texts; each gives about the
    same number of rows, chosen by a hash of the text, which also says where
    in the text the window is. The most frequent languages take part.
    """
    known = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return pa.table({"lang": pa.array([], pa.string()), "part": pa.array([], pa.string())})
    share = sample_rows / len(sizes)
    rates = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 1.2 * share / r.n)) for r in sizes], "of string, rate double")
    place = F.xxhash64("doc_id", "text")
    uniform = F.pmod(place, F.lit(1 << 40)) / float(1 << 40)
    rows = known.where(_letters()).join(F.broadcast(rates), F.col("lang") == F.col("of")).where(uniform < F.col("rate"))
    start = F.pmod(F.shiftright(place, 20), F.greatest(F.char_length("text") - WINDOW // 2, F.lit(1))).cast("int") + 1
    return rows.select("lang", F.substring("text", start, F.lit(WINDOW)).alias("part"), place.alias("place")).orderBy("place", "lang").limit(sample_rows).toArrow().sort_by([("place", "ascending"), ("lang", "ascending")])


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network:
    """A network fit to documents (doc_id, text, lang); rows without a language or a letter teach nothing.

    Without any labelled row it knows no language.
    """
    sample = labelled_sample(docs, sample_rows)
    texts = [t.encode()[:WINDOW] for t in sample["part"].to_pylist()]
    windows = np.frombuffer(b"".join(t.ljust(SPAN, b"\0") for t in texts), np.uint8).reshape(-1, SPAN)
    languages = sorted(set(sample["lang"].to_pylist()))
    number = {x: k for k, x in enumerate(languages)}
    return fit(windows, np.array([number[x] for x in sample["lang"].to_pylist()], np.int64), languages)


def _predictor(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            known = batch["letters"].to_pylist()
            texts = [(t or "").encode() if k and net.languages else b"" for t, k in zip(batch["text"].to_pylist(), known, strict=True)]
            p = net.texts(texts)
            best = p.argmax(axis=1) if net.languages else np.zeros(len(texts), int)
            lang = [net.languages[b] if t else UNKNOWN for b, t in zip(best, texts, strict=True)]
            score = [float(min(p[i, b], 1.0)) if t else 0.0 for i, (b, t) in enumerate(zip(best, texts, strict=True))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang_pred, score (its mean probability) of every row of documents (doc_id, text).

    Texts that are null or have no letter are ``und`` with score 0, as are all
    where no language is known; very long texts are read whole, window by
    window; equal probabilities go to the first language by name; repeated
    rows are predicted alike; an empty table gives no row; extra columns are
    ignored.
    """
    spark: SparkSession = docs.sparkSession
    held = spark.sparkContext.broadcast(net)
    return docs.select("doc_id", "text", _letters().alias("letters")).mapInArrow(_predictor(held), "doc_id long, lang_pred string, score double")
