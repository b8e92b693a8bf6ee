"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share seeds (five consecutive tokens) are
compared by greedy string tiling: the longest common unmarked runs are marked
as tiles first, then shorter ones, down to the seed length; runs of each
length are found by running Karp-Rabin hashes. Tiles don't overlap, but may lie
in any order, so reordered passages count. An item whose tokens are covered by
tiles to the threshold is found in the document. Items of which shared seeds
can't cover that much are left out before tiling. An item of fewer tokens than
a seed is found where it is a document's whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONGEST_UNIT, lower_ascii, new_path, row_ids, table, words_of

SEED = 5
THRESHOLD = 0.6
#: Characters of benchmark text that are broadcast at once; more take more passes.
BLOCK_CHARS = 16 << 20
CACHE = 300_000
_MARKS = ".,;:!?\"'()[]{}<>#$%&*|-_=~+/\\«»¿¡…“”‘’"
_BASE = (1 << 61) - 1, 1_000_003
_STEPS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SEED)], np.uint64)


def token(word: str) -> str:
    """A word without marks around it, in lower case; may be empty."""
    return lower_ascii(word.strip(_MARKS)).lower()


def _hash(word: str) -> int:
    t = token(word)
    return (xxhash.xxh3_64_intdigest(t.encode()) or 1) if t else 0


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = _hash(word)
        if len(word) <= LONGEST_UNIT:  # longer words are rare, and would fill the memory
            if len(self) > CACHE:
                self.clear()
            self[word] = h
        return h

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Token hashes of a text, and which word each token is (words of marks only give none)."""
        words = words_of(text)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        at = np.flatnonzero(h)
        return h[at], at


def _seeds(h: np.ndarray) -> np.ndarray:
    """Hash of each window of SEED tokens."""
    n = len(h) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SEED):
        out += h[k : k + n] * _STEPS[k]
    return out ^ (out >> np.uint64(31))


def _windows(tokens: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(hash, start) of each window of ``size`` unmarked tokens, rolled along."""
    modulus, base = _BASE
    top = pow(base, size - 1, modulus)
    h, run = 0, 0
    for i, t in enumerate(tokens):
        if not free[i]:
            h, run = 0, 0
            continue
        if run == size:
            h = (h - tokens[i - size] * top) % modulus
            run -= 1
        h = (h * base + t) % modulus
        run += 1
        if run == size:
            yield h, i - size + 1


def _common(document: list[int], item: list[int], free_d: list[bool], free_i: list[bool], size: int) -> bool:
    """Whether unmarked windows of this size have a hash in common."""
    seen = {h for h, _ in _windows(document, free_d, size)}
    return any(h in seen for h, _ in _windows(item, free_i, size))


def _mark(document: list[int], item: list[int], free_d: list[bool], free_i: list[bool], size: int) -> list[tuple[int, int, int]]:
    """Marks common runs of this size, in order of the item's and then the document's positions."""
    places: dict[int, list[int]] = {}
    for h, d in _windows(document, free_d, size):
        places.setdefault(h, []).append(d)
    found: list[tuple[int, int, int]] = []
    next_i = 0
    for h, i in list(_windows(item, free_i, size)):
        if i < next_i or h not in places:
            continue
        left = []
        for k, d in enumerate(places[h]):
            if not all(free_d[d : d + size]):
                continue  # a marked place stays marked
            if item[i : i + size] == document[d : d + size]:
                free_i[i : i + size] = free_d[d : d + size] = [False] * size
                found.append((d, i, size))
                next_i = i + size
                left += places[h][k + 1 :]
                break
            left.append(d)
        places[h] = left
    return found


def tiles(document: list[int], item: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in document, start in item, length) of each tile.

    Longest matches are marked first, ties in order of the item's and then the
    document's positions; every tile has at least ``least`` tokens. The longest
    length is found by halving, so repetitive texts cost no more than others
    per length.
    """
    free_d, free_i = [True] * len(document), [True] * len(item)
    found: list[tuple[int, int, int]] = []
    most = min(len(item), len(document))
    while most >= least and _common(document, item, free_d, free_i, least):
        low, high = least, most
        while low < high:
            middle = (low + high + 1) // 2
            if _common(document, item, free_d, free_i, middle):
                low = middle
            else:
                high = middle - 1
        found += _mark(document, item, free_d, free_i, low)
        most = low - 1
    return found


@dataclass
class Benchmark:
    """Items' tokens and an index of their seeds."""

    ids: list[int]
    tokens: list[list[int]]
    seeds: np.ndarray  # sorted
    items: np.ndarray  # of each seed
    places: np.ndarray  # of each seed in its item
    filter: np.ndarray  # by the upper 20 bits of a seed
    short: dict[tuple[int, ...], list[int]]  # items of fewer tokens than a seed
    times: list[int]  # how often each item was given
    threshold: float
    #: Items that sets of seeds can cover.
    covered: dict[bytes, list[int]] = field(default_factory=dict)

    @staticmethod
    def of(rows: list[tuple], threshold: float = THRESHOLD) -> Benchmark:
        """Of rows (id, text) or (id, text, times)."""
        hashes = _Hashes()
        tokens = [hashes.of(text)[0] for _, text, *_ in rows]
        seeds = [_seeds(t) for t in tokens]
        all_ = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(rows)), [len(s) for s in seeds])
        place = np.concatenate([*(np.arange(len(s)) for s in seeds), np.zeros(0, np.int64)])
        order = np.argsort(all_, kind="stable")
        known = np.zeros(1 << 20, bool)
        known[all_ >> np.uint64(44)] = True
        short: dict[tuple[int, ...], list[int]] = {}
        for k, t in enumerate(tokens):
            if 0 < len(t) < SEED:
                short.setdefault(tuple(t.tolist()), []).append(k)
        times = [n[0] if n else 1 for _, _, *n in rows]
        return Benchmark([r[0] for r in rows], [t.tolist() for t in tokens], all_[order], owner[order], place[order], known, short, times, threshold)

    def _coverable(self, seeds: np.ndarray) -> list[int]:
        """Items whose tokens these (distinct) seeds cover to the threshold; tiles lie within what they cover."""
        key = seeds.tobytes()
        found = self.covered.get(key)
        if found is None:
            low = np.searchsorted(self.seeds, seeds, "left")
            count = np.searchsorted(self.seeds, seeds, "right") - low
            entry = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            order = np.lexsort((self.places[entry], self.items[entry]))
            item, place = self.items[entry][order], self.places[entry][order]
            reach = np.full(len(item), SEED)
            same = item[1:] == item[:-1]
            reach[:-1][same] = np.minimum(np.diff(place), SEED)[same]
            begins = np.flatnonzero(np.r_[True, ~same])[: len(item)]
            cover = np.add.reduceat(reach, begins) if len(item) else reach
            found = [k for k, c in zip(item[begins].tolist(), cover.tolist(), strict=True) if c >= self.threshold * len(self.tokens[k])]
            if len(self.covered) > CACHE // 10:
                self.covered.clear()
            self.covered[key] = found
        return found

    def search(self, hashes: np.ndarray) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """(item, tiles) of every item whose tokens a document's tiles cover to the threshold."""
        if 0 < len(hashes) < SEED:
            return [(k, [(0, 0, len(hashes))]) for k in self.short.get(tuple(hashes.tolist()), ())]
        seeds = _seeds(hashes)
        maybe = np.flatnonzero(self.filter[seeds >> np.uint64(44)])
        at = np.searchsorted(self.seeds, seeds[maybe])
        maybe = maybe[(at < len(self.seeds)) & (self.seeds[np.minimum(at, len(self.seeds) - 1)] == seeds[maybe])] if len(self.seeds) else maybe[:0]
        if not len(maybe):
            return []
        found = []
        for k in self._coverable(np.unique(seeds[maybe])):
            # only runs of shared seeds can hold tiles; separators keep them apart
            starts = maybe[np.isin(seeds[maybe], _seeds(np.array(self.tokens[k], np.uint64)))]
            near = np.unique(np.concatenate([starts + j for j in range(SEED)]))
            cut = np.flatnonzero(np.diff(near) > 1) + 1
            document: list[int] = []
            place: list[int] = []
            for n, part in enumerate(np.split(near, cut)):
                if n:
                    document.append(-n)
                    place.append(-1)
                document += hashes[part].tolist()
                place += part.tolist()
            tiled = [(place[d], i, n) for d, i, n in tiles(document, self.tokens[k])]
            if sum(n for *_, n in tiled) >= self.threshold * len(self.tokens[k]):
                found.append((k, tiled))
        return found


_TILES = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))


def _blocks(benchmark: DataFrame, threshold: float) -> Iterator[Benchmark]:
    """The benchmark in parts of bounded size (one item at least); rows that repeat are in one part, as one item."""
    items = table(benchmark.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times")), "benchmark")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-int(chars) // BLOCK_CHARS)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = sorted(map(tuple, part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        yield Benchmark.of(rows, threshold)


def _in_turn(docs: DataFrame, blocks: Iterator[Benchmark], run, schema: str) -> DataFrame:
    """``run`` over the documents with one block after the other.

    A block's rows are written and it is let go before the next one is
    broadcast, so no task and no plan holds more than one.
    """
    spark = docs.sparkSession
    path = new_path(spark, "decontamination")
    for block in blocks:
        held = spark.sparkContext.broadcast(block)
        docs.mapInArrow(run(held), schema).write.mode("append").parquet(path)
        held.destroy()
    return spark.read.schema(schema).parquet(path)


def _matcher(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark, hashes = held.value, _Hashes()
        for batch in batches:
            rows: list[dict] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, at = hashes.of(text)
                for k, found in benchmark.search(h):
                    covered, whole = sum(n for *_, n in found), len(benchmark.tokens[k])
                    spans = [{"doc_start": int(at[d]), "item_start": i, "length": n} for d, i, n in sorted(found)]
                    row = {"doc_id": doc_id, "item_id": benchmark.ids[k], "covered": covered, "item_tokens": whole, "coverage": covered / whole, "tiles": spans}
                    rows += [row] * benchmark.times[k]
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("covered", pa.int64()), ("item_tokens", pa.int64()), ("coverage", pa.float64()), ("tiles", _TILES)])
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _finder(held):
    """Row keys (column 0) of texts (column 1) in which some item is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark, hashes = held.value, _Hashes()
        for batch in batches:
            found = [bool(benchmark.search(hashes.of(text)[0])) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(found, pa.bool_()))], ["_found"])

    return run


def _keeper(held, at: int):
    """Whole rows without those whose text (column ``at``) holds an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark, hashes = held.value, _Hashes()
        for batch in batches:
            keep = [not benchmark.search(hashes.of(text)[0]) for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document and item (item_id, text) found in it, with its tiles.

    ``doc_start`` counts the document's words, ``item_start`` the item's
    tokens. Null and empty texts match nothing; items of fewer than five tokens
    match documents that have no other tokens. Very long texts are searched
    whole. Of tiles of one length the item's, then the document's first is
    marked. Rows that repeat (documents or items) are reported each; extra
    columns are ignored. An empty benchmark or table gives no row.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, covered long, item_tokens long, coverage double, tiles array<struct<doc_start:int,item_start:int,length:int>>"
    blocks = _blocks(benchmark, threshold)
    head = list(islice(blocks, 2))
    texts = docs.select("doc_id", "text")
    if not head:
        return spark.createDataFrame([], schema)
    if len(head) == 1:
        return texts.mapInArrow(_matcher(spark.sparkContext.broadcast(head[0])), schema)
    return _in_turn(texts, chain(head, blocks), _matcher, schema)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) in which no item is found.

    Rows are judged each for itself, also where doc_ids repeat or are null;
    other cases are those of ``contaminated``. A benchmark of one block is one
    pass without a shuffle; of several, keys of rows are written per block and
    texts are shuffled once.
    """
    spark = docs.sparkSession
    blocks = _blocks(benchmark, threshold)
    head = list(islice(blocks, 2))
    if not head:
        return docs
    if len(head) == 1:
        return docs.mapInArrow(_keeper(spark.sparkContext.broadcast(head[0]), docs.columns.index("text")), docs.schema)
    key = "_row"
    while key in docs.columns:
        key += "_"
    rows = table(row_ids(docs, key), "decontamination-rows")
    found = _in_turn(rows.select(key, "text"), chain(head, blocks), _finder, "_found long").distinct()
    return rows.join(found.hint("shuffle_hash"), rows[key] == found["_found"], "left_anti").drop(key)
