"""Substring dedup with FM-indexes over content-routed shards.

A window is ``WINDOW`` consecutive words of one document. Each window has an
anchor, the smallest hash among its ``GRAM``-word grams; equal windows have
equal anchors, so comparing per anchor loses nothing. Consecutive windows with their
anchor at the same place form a run, which keeps the number of rows far below
that of windows; windows of one run are never equal to each other.

Runs whose anchor occurs once are unique. Where all runs of an anchor are
equal, every run but the first repeats. The others are dealt out by anchor to
shards of bounded size; each shard holds its runs, in corpus order, in an
FM-index, streams every run through it from its end and takes from the matching
statistics which windows also start earlier. Anchors with very many different
runs are dealt out window by window instead, after equal windows were collapsed
where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_words import bounds, hashes, mix, pieces
from .common import table
from .fm_index import FMIndex

WINDOW = 20
GRAM = 6
#: A position packs a document's place in the order of ids, a run's start word
#: and its length; a run has at most WINDOW - GRAM + 1 windows. The start takes
#: as many bits as the longest text needs.
RUN_BITS = 4
RUN = 1 << RUN_BITS
POSITION_BITS = 63
#: Places of words among those hashed at once.
PLACE_BITS = np.uint64(24)
#: Anchors with more runs are dealt out window by window.
HOT_RUNS = 5_000
#: Words in a shard's index.
SHARD_WORDS = 400_000
_MULTIPLIER = 0x9E3779B97F4A7C15
#: Multipliers of the two halves of a content hash.
_MULTIPLIERS = (_MULTIPLIER, 0xD6E8FEB86659FD93)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base, kept for later calls."""
    if len(have := _POWERS.get(base, ())) < n:
        have = np.full(max(n, 1 << 18), base, np.uint64)
        have[:1] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive entries."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def runs(texts: list[list[str]]) -> tuple[np.ndarray, ...]:
    """(text, start word, windows, anchor, two content hashes) of every run of these word lists."""
    column = pa.array([" ".join(t) for t in texts], pa.string())
    parts = [(row + doc, first + start, *rest) for row, first, data, offsets in pieces(column, WINDOW - 1) for doc, start, *rest in [_runs(data, offsets)]]
    return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64),) * 6


def _runs(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of the texts between these offsets of ``data``, as ``runs`` gives them.

    The content hashes come from different halves of the words' 128-bit hashes;
    runs are taken as equal when both are.
    """
    begins, ends = bounds(data, offsets)
    n = len(begins) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    if len(begins) >= 1 << int(PLACE_BITS):
        raise ValueError("more words at once than places")
    firsts = np.searchsorted(begins, offsets)  # number of each text's first word
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    halves = hashes(data, begins, ends)
    h = halves[0]
    grams = np.zeros(len(h) - gram + 1, np.uint64)
    for k in range(gram):
        grams *= np.uint64(_MULTIPLIER)
        grams += h[k : k + len(grams)]
    grams = mix(grams)
    # a gram's upper bits and its place: the least tells the first place of the anchor
    at = (_lowest(grams >> PLACE_BITS << PLACE_BITS | np.arange(len(grams), dtype=np.uint64), window - gram + 1) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    inside = doc[:n] == doc[window - 1 :]
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(at[1:], at[:-1], out=fresh[1:])
    fresh[1:] |= ~inside[:-1]
    fresh &= inside
    begin = np.flatnonzero(fresh)
    size = np.diff(np.r_[0, np.cumsum(inside)][np.r_[begin, n]])
    # hashes of a run's words, from sums of word hashes times powers
    contents = []
    for half, base in zip(halves, _MULTIPLIERS, strict=True):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(half * _powers(base, len(h)), out=sums[1:])
        whole = (sums[begin + size + window - 1] - sums[begin]) * _powers(pow(base, -1, 1 << 64), len(h))[begin]
        contents.append(mix(whole + size.astype(np.uint64)).view(np.int64))
    return doc[begin], begin - firsts[doc[begin]], size, grams[at[begin]].view(np.int64), *contents


def _anchors(start_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, stamp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, first, data, offsets in pieces(batch.column(2), WINDOW - 1):
                doc, start, size, anchor, content, check = _runs(data, offsets)
                pos = (rank[row + doc] << start_bits | (first + start)) << RUN_BITS | (size - 1)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content), pa.array(check), pa.array(pos), pa.array(stamp[row + doc])], ["anchor", "content", "check", "pos", "stamp"])

    return run


def _order_numbers(ids: DataFrame) -> DataFrame:
    """_id, rank: place of each distinct id in their order, counted per sorted partition."""
    ordered = ids.distinct().orderBy("doc_id").select(F.col("doc_id").alias("_id"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    ordered = table(ordered, "order")
    sizes = ordered.groupBy("part").count().collect()  # a row per partition
    before, begins = 0, []
    for part, count in sorted((r["part"], r["count"]) for r in sizes):
        begins.append((part, before - (part << 33)))
        before += count
    shifts = ids.sparkSession.createDataFrame(begins, "part int, shift long")
    return ordered.join(F.broadcast(shifts), "part").select("_id", (F.col("at") + F.col("shift")).alias("rank"))


def _ranked(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents with rank (order of doc_id, nulls last) and stamp (tells apart rows of one doc_id), and the bits of a start.

    Raises ValueError where order and starts need more than 59 bits.
    """
    docs = docs.select("doc_id", "text")
    low, high, longest = docs.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text"))).first()
    low, high = low or 0, high or 0
    start_bits = max(1, ((longest or 0) // 2 + 1).bit_length())
    most = 1 << POSITION_BITS - RUN_BITS - start_bits  # ranks there are
    if high - low + 1 < most:
        rank = F.coalesce(F.col("doc_id") - F.lit(low), F.lit(high - low + 1))
        docs = docs.select(rank.cast("long").alias("rank"), "doc_id", "text")
    else:  # ids too far apart to be packed: their order numbers are
        numbers = _order_numbers(docs.where("doc_id IS NOT NULL").select("doc_id"))
        if numbers.count() >= most:
            raise ValueError(f"{most} ids at most with texts of {longest} bytes")
        docs = docs.join(numbers, docs["doc_id"] == numbers["_id"], "left").select(F.coalesce("rank", F.lit(most - 1)).alias("rank"), "doc_id", "text")
    again = docs.groupBy("rank").count().where("count > 1").limit(1).count()
    return docs.withColumn("stamp", F.xxhash64("text") if again else F.lit(0).cast("long")), start_bits


def _apply(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    """Which of n words the spans (start, end) cover."""
    change = np.zeros(n + 1, np.int64)
    for s, e in spans:
        change[s] += 1
        change[e] -= 1
    return np.cumsum(change[:-1]) > 0


def _outcome(words: list[bytes], gone: np.ndarray | None) -> tuple[int, int, str]:
    kept = words if gone is None else [words[k] for k in np.flatnonzero(~gone).tolist()]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _bytes(column: pa.Array) -> pa.Array:
    """The texts' bytes; ``bytes.split()`` cuts them at the six bytes of white space, as words are."""
    return column.cast(pa.binary())


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FIRST = pa.schema(
    [("rank", pa.int64()), ("stamp", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())]
    + [("spans", _SPANS), ("open", pa.list_(pa.struct([("start", pa.int32()), ("windows", pa.int32()), ("anchor", pa.int64()), ("hot", pa.bool_())])))]
)


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finishes documents without open runs, keeps text and runs of the others."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            n, removed, digest, texts, left = [], [], [], [], []
            waiting = pc.list_value_length(part["open"]).fill_null(0).to_pylist()
            for text, repeats, waits in zip(_bytes(part["text"]).to_pylist(), part["repeats"].to_pylist(), waiting, strict=True):
                spans = [(x["start"], x["start"] + x["windows"] + WINDOW - 1) for x in repeats or ()]
                if waits:
                    outcome = (None, None, None)
                    left.append([{"start": s, "end": e} for s, e in spans])
                    texts.append(text)
                else:
                    words = (text or b"").split()
                    outcome = _outcome(words, _apply(spans, len(words)) if spans else None)
                    left.append([])
                    texts.append(None)
                for column, x in zip((n, removed, digest), outcome, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [part["rank"], part["stamp"], part["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(left, _SPANS), part["open"].cast(_FIRST.field("open").type)], schema=_FIRST
            )


_PIECE = pa.schema([("route", pa.int64()), ("pos", pa.int64()), ("stamp", pa.int64()), ("words", pa.binary()), ("mask", pa.int64())])


def _pieces(start_bits: int):
    """Words of open runs, routed by anchor; windows of hot anchors by their words.

    Of equal windows in a batch only the earliest goes on; the others are known
    to repeat it (mask 1, no words).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            windows: dict[bytes, tuple[int, int, int]] = {}
            for rank, stamp, text, open_ in zip(batch["rank"].to_pylist(), batch["stamp"].to_pylist(), _bytes(batch["text"]).to_pylist(), batch["open"].to_pylist(), strict=True):
                words = text.split()
                for x in open_:
                    start = x["start"]
                    if not x["hot"]:
                        pos = (rank << start_bits | start) << RUN_BITS | (x["windows"] - 1)
                        out.append({"route": x["anchor"], "pos": pos, "stamp": stamp, "words": b" ".join(words[start : start + x["windows"] + WINDOW - 1]), "mask": None})
                        continue
                    for s in range(start, start + x["windows"]):
                        window, mine = b" ".join(words[s : s + WINDOW]), ((rank << start_bits | s) << RUN_BITS, stamp)
                        before = windows.get(window)
                        if before is None or mine[0] < before[0]:
                            windows[window] = mine
                            mine, before = before, mine
                        if mine is not None:
                            late = mine[0] != before[0]  # rows of one id at one place are no repeats
                            out.append({"route": hash(mine) if late else xxhash.xxh3_64_intdigest(window) >> 1, "pos": mine[0], "stamp": mine[1], "words": None if late else window, "mask": 1 if late else None})
            for window, (pos, stamp) in windows.items():
                out.append({"route": xxhash.xxh3_64_intdigest(window) >> 1, "pos": pos, "stamp": stamp, "words": window, "mask": None})
            for at in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_pylist(out[at : at + 20_000], _PIECE)

    return run


def search_shard(rows: list[tuple[int, list[bytes]]], window: int = WINDOW) -> list[int]:
    """For runs (position, words): bit j of a mask tells that window j also starts earlier.

    Runs of equal position are the same place, hence no repeats of each other.
    """
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    numbers: dict[bytes, int] = {}
    texts = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in rows[k][1]], np.int64) for k in order]
    index = FMIndex(texts, len(numbers) + 1)
    places = np.array([rows[k][0] for k in order], np.int64)
    own = index.begin[np.searchsorted(places, places, "left")]
    masks = [0] * len(rows)
    for t, s, e in zip(*(x.tolist() for x in index.matches(texts, own, window)), strict=True):
        masks[order[t]] |= (1 << (e - window + 1)) - (1 << s)
    return masks


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of runs that come sorted by route; a shard holds whole routes.

    Of one route, runs whose words were already seen at an earlier position
    are masked at once, so copies don't fill a shard.
    """
    rows: list[tuple[int, int, list[bytes]]] = []
    size, route = 0, None
    seen: dict[bytes, int] = {}

    def flush() -> pa.RecordBatch:
        masks = search_shard([(p, w) for p, _, w in rows])
        return pa.RecordBatch.from_arrays([pa.array([p for p, *_ in rows], pa.int64()), pa.array([s for _, s, _ in rows], pa.int64()), pa.array(masks, pa.int64())], ["pos", "stamp", "mask"])

    for batch in batches:
        done: list[tuple[int, int, int]] = []
        for r, pos, stamp, words, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if words is None:
                done.append((pos, stamp, mask))
                continue
            if r != route:
                if size >= SHARD_WORDS:
                    yield flush()
                    rows, size = [], 0
                route, seen = r, {}
            first = seen.setdefault(words, pos)  # rows of a route come by position
            if first != pos:
                done.append((pos, stamp, (1 << ((pos & (RUN - 1)) + 1)) - 1))
                continue
            rows.append((pos, stamp, words.split(b" ")))
            size += len(rows[-1][2])
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*done, strict=True)], ["pos", "stamp", "mask"])
    if rows:
        yield flush()


def _second_pass(start_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids += part["doc_id"].to_pylist()
                for text, spans, verdicts in zip(_bytes(part["text"]).to_pylist(), part["spans"].to_pylist(), part["verdicts"].to_pylist(), strict=True):
                    words = text.split()
                    gone = [(s["start"], s["end"]) for s in spans]
                    for v in verdicts or ():
                        start = v["pos"] >> RUN_BITS & ((1 << start_bits) - 1)
                        gone += [(start + j, start + j + WINDOW) for j in range(RUN) if v["mask"] >> j & 1]
                    out.append(_outcome(words, _apply(gone, len(words)) if gone else None))
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def deduplicate(docs: DataFrame, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs`` (doc_id, text).

    Each word in a window whose words also start earlier (smaller doc_id, or
    the same document before) is removed. Null texts have no words; texts
    shorter than a window stay whole. Null ids come last. Rows that repeat a
    doc_id are the same place: equal windows at equal starts of such rows are
    no repeats of each other. Extra columns are ignored.
    """
    docs, start_bits = _ranked(docs)
    found = docs.select("rank", "stamp", "text").mapInArrow(_anchors(start_bits), "anchor long, content long, check long, pos long, stamp long")
    per_anchor = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("low"), F.max("content").alias("high"), F.min("check").alias("check_low"), F.max("check").alias("check_high"), F.min("pos").alias("first"))
    anchors = table(per_anchor.where("n > 1").select(F.col("anchor").alias("_anchor"), "n", F.expr("low <> high OR check_low <> check_high").alias("mixed"), "first"), "anchors")
    # runs that may repeat: of a pure anchor all but the first do
    shared = found.join(anchors, found["anchor"] == anchors["_anchor"]).where("mixed OR pos <> first").select("anchor", "content", "check", "pos", "stamp", "mixed", (F.col("n") > hot_runs).alias("hot"))
    shared = table(shared, "runs")
    mixed = shared.where("mixed")
    firsts = table(mixed.groupBy(F.col("anchor").alias("_anchor"), F.col("content").alias("_content"), F.col("check").alias("_check")).agg(F.min("pos").alias("first")), "firsts")
    same = (mixed["anchor"] == firsts["_anchor"]) & (mixed["content"] == firsts["_content"]) & (mixed["check"] == firsts["_check"])
    placed = mixed.join(firsts, same).select("anchor", "pos", "stamp", "hot", (F.col("pos") == F.col("first")).alias("open"))
    everything = shared.where("NOT mixed").select("anchor", "pos", "stamp", "hot", F.lit(False).alias("open")).unionByName(placed)
    start = F.shiftrightunsigned("pos", RUN_BITS).bitwiseAND((1 << start_bits) - 1).cast("int")
    run = F.struct(start.alias("start"), (F.col("pos").bitwiseAND(RUN - 1) + 1).cast("int").alias("windows"), "anchor", "hot")
    lists = everything.groupBy(F.shiftrightunsigned("pos", start_bits + RUN_BITS).alias("_rank"), F.col("stamp").alias("_stamp")).agg(
        F.collect_list(F.when(~F.col("open"), F.struct(run["start"].alias("start"), run["windows"].alias("windows")))).alias("repeats"), F.collect_list(F.when(F.col("open"), run)).alias("open")
    )
    with_lists = docs.join(lists.hint("shuffle_hash"), (docs["rank"] == lists["_rank"]) & (docs["stamp"] == lists["_stamp"]), "left").select("rank", "stamp", "doc_id", "text", "repeats", "open")
    schema = "rank long, stamp long, doc_id long, n_words long, n_removed long, kept_sha256 string, text string, spans array<struct<start:int,end:int>>, open array<struct<start:int,windows:int,anchor:long,hot:boolean>>"
    first = table(with_lists.mapInArrow(_first_pass, schema), "first-pass")
    waiting = first.where("kept_sha256 IS NULL")
    pieces = waiting.select("rank", "stamp", "text", "open").mapInArrow(_pieces(start_bits), "route long, pos long, stamp long, words binary, mask long")
    masks = pieces.repartition("route").sortWithinPartitions("route", "pos").mapInArrow(_shards, "pos long, stamp long, mask long")
    verdicts = (
        masks.where("mask <> 0")
        .groupBy(F.shiftrightunsigned("pos", start_bits + RUN_BITS).alias("_rank"), F.col("stamp").alias("_stamp"))
        .agg(F.collect_list(F.struct("pos", "mask")).alias("verdicts"))
    )
    verdicts = table(verdicts, "verdicts")
    last = waiting.join(verdicts.hint("shuffle_hash"), (waiting["rank"] == verdicts["_rank"]) & (waiting["stamp"] == verdicts["_stamp"]), "left").select("doc_id", "text", "spans", "verdicts")
    decided = last.mapInArrow(_second_pass(start_bits), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return first.where("kept_sha256 IS NOT NULL").select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(decided)
