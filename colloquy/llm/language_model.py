"""Hashed maximum-entropy language model with a class-factored softmax.

p(word | history) = p(class | history) p(word | class, previous class). Both
factors are log-linear. Features of the first are hashed rows for the previous
word, the word before it (a skip) and the pair of both; features of the second
are the class and the previous class. The most frequent words (``HEAD``) fill
classes of at most ``WIDTH`` words; every other word belongs to the tail class
of its topic, within which it has its add-one relative frequency. One more class
stands for a repetition of the previous word. Topics are clusters of words by
the company they keep, carried to all words by their endings.

Word counts, co-occurrences and tail totals cover all training tokens. Weights
are trained in rounds: each task makes gradient updates over its own documents
and the results are averaged, block by block; every training document is used
in exactly one round. Parameters, head and hot words are bounded by constants.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONGEST_UNIT, lower_ascii, most_frequent, row_ids, table, words_of

END = " "  # no word equals it
HEAD = 4096
WIDTH = 64
TOPICS = 8
#: Words (of at most 64 bytes) whose counts are broadcast, and those that topics are learned from.
HOT = 1 << 17
KNOWN_TOPICS = 1 << 14
CONTEXTS = 64
#: How far apart words still keep company.
GAPS = 4
ROWS = 1 << 12
ROUNDS = 2
STEP_TOKENS = 8192
BLOCK = 1 << 16
FLUSH = 400_000
CACHE = 600_000
#: What gradients are multiplied by.
PART = np.float32(0.05)


def tokens_of(text: str | None) -> list[str]:
    """Words of a text with A-Z in lower case, then the end token."""
    words = words_of(lower_ascii(text or ""))
    words.append(END)
    return words


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["unit", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(tokens_of(text))
            if len(counts) > FLUSH:
                yield out()
                counts.clear()
    yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """unit, n of every distinct token of ``docs`` (text)."""
    return docs.select("text").mapInArrow(_count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def _blocks(flat: np.ndarray, weight: int) -> pa.RecordBatch:
    parts = [flat[k : k + BLOCK].astype(np.float32) for k in range(0, len(flat), BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([weight] * len(parts), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "weight", "data"])


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    weights: Counter[int] = Counter()
    for batch in batches:
        for block, weight, data in zip(*(batch.column(k) for k in range(3)), strict=True):
            b, part = block.as_py(), np.frombuffer(data.as_buffer(), np.float32)
            weights[b] += weight.as_py()
            if b in sums:
                sums[b] += part
            else:
                sums[b] = part.astype(np.float64)
    names = sorted(sums)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([weights[b] for b in names], pa.int64()), pa.array([sums[b].astype(np.float32).tobytes() for b in names], pa.binary())], ["block", "weight", "data"])


def _gathered(rows: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Sum of the vectors of ``size`` entries that tasks sent in blocks, and of their weights.

    Blocks are summed in two steps, first over about the square root of the
    tasks each, then per block; what reaches the driver is one vector of fixed
    size. Partitions are counted here so that what one task reads grows with
    the square root of the tasks only.
    """
    schema = "block int, weight long, data binary"
    parts, blocks = max(1, round(rows.rdd.getNumPartitions() ** 0.5)), -(-size // BLOCK)
    dealt = rows.withColumn("part", F.spark_partition_id() % parts).repartition(parts * -(-blocks // 4), "block", "part").select("block", "weight", "data")
    halfway = dealt.mapInArrow(_sum_blocks, schema)
    found = halfway.repartition(-(-blocks // 4), "block").mapInArrow(_sum_blocks, schema).toArrow().sort_by("block")
    if not found.num_rows:
        return np.zeros(0), 0
    return np.concatenate([np.frombuffer(x.as_py(), np.float32) for x in found["data"]]).astype(np.float64), found["weight"][0].as_py()


class _Index(dict):
    """word -> its number; words without one get ``len`` (for co-occurrence)."""

    def __init__(self, words: list[str]) -> None:
        super().__init__(zip(words, range(len(words)), strict=True))
        self.none = len(words)

    def __missing__(self, word: str) -> int:
        return self.none


def _company(index, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = index.value
        pad = [n + 1] * GAPS  # between documents, and at both ends
        sums = np.zeros((n + 2) * (CONTEXTS + 1))
        for group in _groups((x for batch in batches for x in batch.column(0).to_pylist()), 8 * STEP_TOKENS):
            numbers: list[int] = list(pad)
            for words in group:
                numbers.extend(map(look.__getitem__, words))
                numbers.extend(pad)
            ids = np.array(numbers, np.int32)
            place = np.flatnonzero(ids < min(CONTEXTS, n))
            near = ids[place]
            keys = [ids[place + gap] * np.int32(CONTEXTS + 1) + near for gap in range(-GAPS, GAPS + 1) if gap]
            sums += np.bincount(np.concatenate(keys), minlength=len(sums))
        yield _blocks(sums[: (n + 1) * (CONTEXTS + 1)], 1)

    return run


def topics(company: np.ndarray, counts: np.ndarray, k: int = TOPICS, rounds: int = 25) -> np.ndarray:
    """Spherical k-means of words by square roots of their company, weighted by count."""
    if not len(company):
        return np.zeros(0, np.int64)
    x = np.sqrt(company)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    k = min(k, len(x))
    centres = [x[0]]
    for _ in range(1, k):  # farthest-first among frequent words
        head = x[: max(k, 256)]
        centres.append(head[np.argmin(np.max(head @ np.array(centres).T, axis=1))])
    c = np.array(centres)
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        label = np.argmax(x @ c.T, axis=1)
        for t in range(k):
            if (label == t).any():
                v = (x[label == t] * np.sqrt(counts[label == t])[:, None]).sum(axis=0)
                c[t] = v / max(np.linalg.norm(v), 1e-9)
    return label


def endings(words: list[str], labels: np.ndarray, counts: np.ndarray) -> dict[str, int]:
    """Topic of each ending of one to four characters, by the weight of its words."""
    votes: dict[str, np.ndarray] = {}
    for w, t, n in zip(words, labels.tolist(), counts.tolist(), strict=True):
        for k in range(1, 5):
            votes.setdefault(w[-k:], np.zeros(TOPICS))[t] += n**0.5
    return {s: int(np.argmax(v)) for s, v in votes.items()}


@dataclass
class Vocabulary:
    """Bounded tables that map words to classes."""

    hot: dict[str, int]  # word -> number, by falling count
    count: np.ndarray  # of hot words
    topic: np.ndarray  # of hot words
    klass: np.ndarray  # of hot words: head class, or the topic's tail class
    member: np.ndarray  # place within a head class
    ending: dict[str, int]
    heads: int  # head classes
    sizes: np.ndarray  # words of each head class
    tail_total: np.ndarray | None = None  # log10 of tokens + words + 1, by topic

    @property
    def classes(self) -> int:
        return self.heads + TOPICS + 1

    def topic_of(self, word: str) -> int:
        for k in range(4, 0, -1):
            if (t := self.ending.get(word[-k:])) is not None:
                return t
        return zlib.crc32(word.encode()) % TOPICS


def vocabulary(words: list[str], counts: np.ndarray, known: np.ndarray) -> Vocabulary:
    """Tables from the hot words, their counts and the topics of the first of them."""
    ending = endings(words[: len(known)], known, counts[: len(known)])
    if not words:  # nothing is known: one entry that no word has
        counts = np.zeros(1)
    n = len(counts)
    v = Vocabulary(dict(zip(words, range(len(words)), strict=True)), counts, np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), ending, 0, np.zeros(0, np.int64))
    v.topic[: len(known)] = known
    v.topic[len(known) : len(words)] = [v.topic_of(w) for w in words[len(known) :]]
    sizes: list[int] = []
    for t in range(TOPICS):
        mine = np.flatnonzero(v.topic[: min(HEAD, len(words))] == t)
        for at in range(0, len(mine), WIDTH):
            part = mine[at : at + WIDTH]
            v.klass[part], v.member[part] = len(sizes), np.arange(len(part))
            sizes.append(len(part))
    v.heads, v.sizes = len(sizes), np.array(sizes, np.int64)
    v.klass[HEAD:] = v.heads + v.topic[HEAD:]
    return v


class Coder(dict):
    """word -> number of a hot word, or cold: HOT + topic, and its place in ``words`` above bit 32.

    Within one list of texts, codes are equal exactly where words are.
    """

    def __init__(self, v: Vocabulary) -> None:
        super().__init__(v.hot)
        self.v = v
        self.cold: dict[str, int] = {}
        self.words: list[str] = [""]
        self.endings: dict[str, int] = {}  # topics of the last four characters of cold words

    def renew(self) -> None:
        """Forgets cold words when they are many; codes given before no longer hold."""
        if len(self.words) > CACHE:
            self.cold.clear()
            self.endings.clear()
            del self.words[1:]

    def __missing__(self, word: str) -> int:
        code = self.cold.get(word)
        if code is None:
            topic = self.endings.get(word[-4:])
            if topic is None:
                topic = self.v.topic_of(word)
                if word[-1:] in self.v.ending:  # else the whole word decides
                    self.endings[word[-4:]] = topic
            code = self.cold[word] = len(self.words) << 32 | (HOT + topic)
            self.words.append(word)
        return code


class Net:
    """Parameters as one flat vector, and views into it."""

    def __init__(self, v: Vocabulary, flat: np.ndarray | None = None) -> None:
        self.v, c, h = v, v.classes, max(v.heads, 1)
        shapes = [(3 * ROWS, c), (1, c), (c * h, WIDTH), (h, WIDTH)]
        ends = np.cumsum([a * b for a, b in shapes])
        self.flat = np.zeros(ends[-1], np.float32) if flat is None else flat.astype(np.float32)
        self.rows, self.bias, self.inner, self.inner_bias = (self.flat[e - a * b : e].reshape(a, b) for (a, b), e in zip(shapes, ends, strict=True))
        self.outside = np.arange(WIDTH)[None, :] >= (v.sizes[:, None] if v.heads else np.full((1, 1), WIDTH))
        if flat is None:
            weight = np.bincount(v.klass, v.count, c) + 1.0
            self.bias[0] = np.log(weight / weight.sum())
            head = np.flatnonzero(v.klass < v.heads)
            self.inner_bias[v.klass[head], v.member[head]] = np.log(v.count[head] + 1.0)
            self.inner_bias -= self.inner_bias.max(axis=1, keepdims=True)
            self.inner_bias[self.outside] = -1e9  # never drawn


@dataclass
class Tokens:
    """Arrays over the tokens of some documents."""

    code: np.ndarray
    place: np.ndarray  # hot words, then topics of cold ones, in one table
    lengths: np.ndarray  # tokens of each document
    klass: np.ndarray
    member: np.ndarray
    before: np.ndarray  # class of the previous token
    features: np.ndarray  # three rows per token, a column in one piece each
    cold: np.ndarray


def _hashed(x: np.ndarray, feature: int) -> np.ndarray:
    return ((x * 0x9E3779B1 >> 11 & (ROWS - 1)) + feature * ROWS).astype(np.uint16 if 3 * ROWS <= 1 << 16 else np.int32)


def encode(coder: Coder, texts: list[list[str]]) -> Tokens:
    v = coder.v
    coder.renew()
    lengths = np.array([len(t) for t in texts])
    code = np.fromiter(map(coder.__getitem__, itertools.chain.from_iterable(texts)), np.int64, int(lengths.sum()))
    low = code.astype(np.int32)  # the lower half
    cold = low >= HOT
    size = len(v.count)
    place = np.where(cold, low - (HOT - size), low)
    klass = np.concatenate([v.klass, v.heads + np.arange(TOPICS)]).astype(np.int32).take(place)
    member = np.concatenate([v.member, np.zeros(TOPICS, np.int64)]).astype(np.int32).take(place)
    own = np.where(klass < v.heads, low, HEAD + klass).astype(np.int64)  # what contexts see
    begins = np.cumsum(lengths) - lengths
    one = np.empty_like(own)
    one[1:] = own[:-1]
    one[begins] = -1
    two = np.empty_like(own)
    two[2:] = own[:-2]
    two[begins] = -1
    two[(begins + 1)[lengths > 1]] = -1
    before = np.empty_like(klass)
    before[1:] = klass[:-1]
    before[begins] = v.classes - 1
    repeated = np.zeros(len(code), bool)
    repeated[1:] = code[1:] == code[:-1]
    repeated[begins] = False
    klass[repeated] = v.classes - 1
    features = np.stack([_hashed(one + 7, 0), _hashed(two + 77, 1), _hashed((one + 7) * 40503 + two * 69069 + 5, 2)]).T
    return Tokens(code, place, lengths, klass, member, before, features, cold)


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of each row and its sum; rows are shifted by their largest entries only where float32 would overflow or vanish."""
    ones = np.ones(x.shape[1], np.float32)
    with np.errstate(over="ignore"):
        e = np.exp(x)
        total = e @ ones
    if not (total.min(initial=1) > 1e-30 and total.max(initial=1) < 1e30):
        x = x - x.max(axis=1, keepdims=True)
        e = np.exp(x)
        total = e @ ones
    return e, total


def _errors(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Softmax of each row less 1 at its target, times the part of a step."""
    e, total = _exponentials(x)
    e *= (PART / total)[:, None]
    e[np.arange(len(e)), target] -= PART
    return e


def _log_softmax_at(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log10 of each row's softmax at its target."""
    e, total = _exponentials(x)
    return np.log10(e[np.arange(len(e)), target] * (1 / total) + 1e-12)


def _scatter(rows: np.ndarray, grads: np.ndarray, few: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sum of each one's gradients.

    Rows that come up to ``few`` times are summed side by side, one more
    gradient each time; the others one after the other.
    """
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    at = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    size = np.diff(np.r_[at, len(rows)])
    sorted_ = grads.take(order, axis=0)
    sums = sorted_.take(at, axis=0)
    for k in range(1, few):
        more = np.flatnonzero((size > k) & (size <= few))
        if len(more):
            part = sums.take(more, axis=0)
            part += sorted_.take(at[more] + k, axis=0)
            sums[more] = part
    for i in np.flatnonzero(size > few).tolist():
        np.add.reduce(sorted_[at[i] : at[i] + size[i]], axis=0, out=sums[i])
    return ordered[at], sums


def _class_weights(net: Net, t: Tokens, s: slice) -> np.ndarray:
    first, *others = t.features[s].T
    x = net.rows.take(first, axis=0)
    for f in others:
        x += net.rows.take(f, axis=0)
    x += net.bias
    return x


def _member_weights(net: Net, t: Tokens, s: slice, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of ``inner`` of each head token, and the weights of its class's members."""
    k = t.klass[s][head]
    row = t.before[s][head] * np.int32(net.v.heads) + k
    x = net.inner.take(row, axis=0)
    x += net.inner_bias.take(k, axis=0)
    return row, x


def log_probabilities(net: Net, t: Tokens, step: int = STEP_TOKENS) -> np.ndarray:
    """log10 of p(class | history), times p(word | class, ...) for head classes."""
    v, out = net.v, np.zeros(len(t.code))
    for at in range(0, len(out), step):
        s = slice(at, at + step)
        out[s] = _log_softmax_at(_class_weights(net, t, s), t.klass[s])
        head = np.flatnonzero(t.klass[s] < v.heads)
        if len(head):
            _, x = _member_weights(net, t, s, head)
            out[at + head] += _log_softmax_at(x, t.member[s][head])
    return out


class Trainer:
    """Adagrad with one step size per row of a net."""

    def __init__(self, net: Net, rate: float = 0.15) -> None:
        self.net, self.rate = net, np.float32(rate)
        self.seen = {name: np.full((len(getattr(net, name)), 1), 0.05, np.float32) for name in ("rows", "inner")}

    def _move(self, name: str, rows: np.ndarray, grads: np.ndarray) -> None:
        where, g = _scatter(rows, grads)
        w = getattr(self.net, name)
        total = self.seen[name].take(where, axis=0)
        total += np.einsum("ij,ij->i", g, g)[:, None] * np.float32(4 / g.shape[1])
        self.seen[name][where] = total
        g *= self.rate / np.sqrt(total)
        np.subtract(w.take(where, axis=0), g, out=g)
        w[where] = g

    def update(self, t: Tokens, s: slice) -> None:
        net, v = self.net, self.net.v
        g = _errors(_class_weights(net, t, s), t.klass[s])
        for f in t.features[s].T:
            self._move("rows", f, g)
        head = np.flatnonzero(t.klass[s] < v.heads)
        if len(head):
            row, x = _member_weights(net, t, s, head)
            g = _errors(x, t.member[s][head])
            self._move("inner", row.astype(np.uint16) if len(net.inner) <= 1 << 16 else row, g)


def _groups(texts: Iterator[str | None], most: int = 8 * STEP_TOKENS) -> Iterator[list[list[str]]]:
    """Tokenised texts in lists of about ``most`` tokens."""
    group, size = [], 0
    for text in texts:
        group.append(tokens_of(text))
        size += len(group[-1])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _train(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, flat = held.value
        coder, net = Coder(v), Net(v, flat)
        trainer, seen = Trainer(net), 0
        for group in _groups(x for batch in batches for x in batch.column(0).to_pylist()):
            t = encode(coder, group)
            for at in range(0, len(t.code), STEP_TOKENS):
                trainer.update(t, slice(at, at + STEP_TOKENS))
            seen += len(t.code)
        if seen:
            yield _blocks(net.flat * np.float32(seen), seen)

    return run


def _tails(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        sums = np.zeros((TOPICS, 2), np.int64)
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                i = v.hot.get(w)
                if i is None or v.klass[i] >= v.heads:
                    t = v.topic_of(w) if i is None else v.topic[i]
                    sums[t] += (n, 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(TOPICS), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["topic", "tokens", "words"])

    return run


@dataclass
class Model:
    vocabulary: Vocabulary
    flat: np.ndarray
    tokens: int
    words: int


def train(docs: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> Model:
    """Fits the model to training documents (doc_id, text) and their word counts (a table)."""
    sc = docs.sparkSession.sparkContext
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    hot = most_frequent(counts, HOT, LONGEST_UNIT)
    words, n = hot["unit"].to_pylist(), hot["n"].to_numpy().astype(float)
    texts = docs.select("text")
    if not total["n"]:
        return Model(vocabulary([], n, np.zeros(0, np.int64)), np.zeros(0, np.float32), 0, 0)
    seed = words[:KNOWN_TOPICS]
    company, _ = _gathered(texts.mapInArrow(_company(sc.broadcast(_Index(seed)), len(seed)), "block int, weight long, data binary"), (len(seed) + 1) * (CONTEXTS + 1))
    near = company.reshape(len(seed) + 1, CONTEXTS + 1)[: len(seed), : min(CONTEXTS, len(seed))]
    v = vocabulary(words, n, topics(near, n[: len(seed)]))
    tails = counts.mapInArrow(_tails(sc.broadcast(v)), "topic int, tokens long, words long").groupBy("topic").agg(F.sum("tokens").alias("t"), F.sum("words").alias("w")).collect()
    v.tail_total = np.zeros(TOPICS)
    for r in tails:
        v.tail_total[r.topic] = np.log10(r.t + r.w + 1)
    net = Net(v)
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))
    for k in range(rounds):
        part = docs.where(share == k).select("text")
        sums, weight = _gathered(part.mapInArrow(_train(sc.broadcast((v, net.flat))), "block int, weight long, data binary"), len(net.flat))
        if weight:
            net = Net(v, sums / weight)
    return Model(v, net.flat, int(total["n"] or 0), int(total["v"]))


_SCORED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("unit", pa.string()), ("freq", pa.int64()), ("scored", pa.int64())]
)


def _cold_rows(coder: Coder, t: Tokens, repeat: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Cold words of each document: how often they occur, and how often not as a repetition."""
    place = np.flatnonzero(t.cold)
    doc = np.repeat(np.arange(len(t.lengths)), t.lengths)[place]
    pairs, which, freq = np.unique(doc << 32 | t.code[place] >> 32, return_inverse=True, return_counts=True)
    scored = np.bincount(which, ~repeat[place], len(pairs)).astype(np.int64)
    none = np.zeros(len(pairs), np.int64)
    units = [coder.words[w] for w in (pairs & 0xFFFFFFFF).tolist()]
    ids = pa.nulls(len(pairs), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(rows[pairs >> 32]), ids, pa.array(none), pa.array(none), pa.array(none.astype(float)), pa.array(none.astype(float)), pa.array(units, pa.string()), pa.array(freq), pa.array(scored)], schema=_SCORED)


def _scorer(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        v = model.vocabulary
        coder, net = Coder(v), Net(v, model.flat) if model.tokens else None
        # log10 of count + 1 of hot words; of cold ones it is added where counts are joined
        log_count = np.r_[np.log10(v.count + 1), np.zeros(TOPICS)]
        tail_total = np.zeros(TOPICS) if v.tail_total is None else v.tail_total
        for batch in batches:
            rows, ids, texts = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_pylist()
            at = 0
            for group in _groups(texts):
                t = encode(coder, group)
                k = len(group)
                value = log_count.take(t.place)
                repeat = t.klass == v.classes - 1
                tail = np.flatnonzero((t.klass >= v.heads) & ~repeat)
                logp = log_probabilities(net, t) if net else np.full(len(t.code), -np.log10(v.classes))
                logp[tail] += value[tail] - tail_total[t.klass[tail] - v.heads]
                begins = np.cumsum(t.lengths) - t.lengths  # no document is without a token
                known, base, score = (np.add.reduceat(x, begins) for x in ((~t.cold).astype(np.int64), value, logp))
                none = pa.array(np.zeros(k, np.int64))
                mine = rows[at : at + k]
                yield pa.RecordBatch.from_arrays([pa.array(mine), ids.slice(at, k), pa.array(t.lengths), pa.array(known), pa.array(base), pa.array(score), pa.array([f" {r}" for r in mine.tolist()]), none, none], schema=_SCORED)
                if t.cold.any():
                    yield _cold_rows(coder, t, repeat, mine)
                at += k

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of ``docs``.

    ``base_score`` is the add-one unigram log10 probability, ``score`` the
    model's. Words outside the broadcast ones are joined to their counts. Null
    and empty texts are the end token alone; repeated rows score alike; extra
    columns are ignored. A repeated word takes the repetition class only, so
    the model's probabilities sum to at most one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = "row long, doc_id long, tokens long, known long, base double, score double, unit string, freq long, scored long"
    pairs = row_ids(docs.select("doc_id", "text")).select("_row", "doc_id", "text").mapInArrow(_scorer(held), schema)
    joined = pairs.join(counts.hint("merge"), "unit", "left")
    logc = F.log10(F.coalesce("n", F.lit(0)) + 1)
    whole = float(np.log10(model.tokens + model.words + 1))
    return (
        joined.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.sum("tokens").alias("n_tokens"),
            F.sum(F.col("known") + F.when(F.col("n") > 0, F.col("freq")).otherwise(0)).alias("n_known"),
            (F.sum(F.col("base") + F.col("freq") * logc) - F.sum("tokens") * whole).alias("base_score"),
            F.sum(F.col("score") + F.col("scored") * logc).alias("score"),
        )
        .drop("row")
    )
