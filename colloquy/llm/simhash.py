"""SimHash near-dedup by anchor points of a covering code.

A fingerprint is split into three segments. Of two fingerprints that differ in
at most four bits, one segment differs in at most one (three segments, four
bits). Anchors of a segment are the words whose first 15 bits are a codeword
of the Hamming(15, 11) code; it covers all words with radius 1. Every
fingerprint has one home anchor per segment, and is replicated to each anchor
within radius plus threshold (1 + 1) of it, hence any linked pair meets at the
home anchor of either. Pairs are compared at the anchors; each task reports a
spanning forest of what it found instead of all pairs. A crowded anchor's homes
and members are dealt out in blocks, so that each pair of blocks is a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_of_group, later_of_group, lower_ascii, most_frequent, table, words_of
from .graph import components

SEED = 42
SHINGLE = 4
MOST_BITS = 4
#: Bit ranges of the segments; the first CODED bits of each are covered by the code.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
CODED = 15
#: Anchors of one segment that share members with an anchor, itself included: 35 codewords at distance 3, 7 flips of a bit.
NEAR_ANCHORS = 43
#: Anchors with more members are dealt out in blocks, at most CROWDED of them.
MEMBERS = 20_000
CROWDED = 1 << 16
#: Bits of an anchor; the block's number lies above.
ANCHOR_BITS = 36
#: Pairs compared at once.
BLOCK = 1 << 21


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text's word shingles, as an unsigned 64-bit number.

    Fewer words than a shingle give one shingle of them all; no word gives 0.
    """
    words = words_of(lower_ascii(text or ""))
    if not words:
        return 0
    data = " ".join(words).encode()
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(data)]
    last = min(size, len(words)) - 1
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(data[a:b], seed) for a, b in zip(starts[: len(starts) - last].tolist(), ends[last:].tolist(), strict=True)], "<u8")
    set_bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every row."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Home codeword of each 15-bit word, and its codewords within distance 2 (-1: none)."""
    words = np.arange(1 << CODED)
    syndrome = np.zeros(1 << CODED, np.int64)
    for p in range(CODED):
        syndrome ^= np.where(words >> p & 1, p + 1, 0)
    flip = np.r_[0, 1 << np.arange(CODED)]
    near = np.full((1 << CODED, 8), -1)
    home = words ^ flip[syndrome]
    near[:, 0] = home
    for s in range(1, CODED + 1):
        at = syndrome == s
        pairs = [(i, i ^ s) for i in range(1, CODED + 1) if i < i ^ s]
        for k, (i, j) in enumerate(pairs):
            near[at, k + 1] = words[at] ^ flip[i] ^ flip[j]
    return home, near


def _keys(number: int, word: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return number << 32 | rest << CODED | word


def _segment(fp: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Coded and other bits of a segment."""
    low, bits = SEGMENTS[number]
    value = (fp.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << bits) - 1)
    return value & ((1 << CODED) - 1), value >> CODED


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    home, _ = _code_tables()
    for batch in batches:
        fp = batch.column(0).to_numpy()
        for number in range(len(SEGMENTS)):
            coded, rest = _segment(fp, number)
            yield pa.RecordBatch.from_arrays([pa.array(_keys(number, home[coded], rest))], ["anchor"])


def _replicas(fp: np.ndarray, home: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fingerprint, whether it is the home) of all anchors of these fingerprints."""
    keys, fps, homes = [], [], []
    for number, (_, bits) in enumerate(SEGMENTS):
        coded, rest = _segment(fp, number)
        reached = near[coded][:, 1:]
        there = reached >= 0
        keys += [_keys(number, home[coded], rest), _keys(number, reached, rest[:, None])[there]]
        fps += [fp, np.broadcast_to(fp[:, None], there.shape)[there]]
        for bit in range(bits - CODED):
            keys.append(_keys(number, home[coded], rest ^ (1 << bit)))
            fps.append(fp)
        homes += [np.ones(len(fp), bool), np.zeros(sum(map(len, keys)) - sum(map(len, homes)) - len(fp), bool)]
    return np.concatenate(keys), np.concatenate(fps), np.concatenate(homes)


def _dealt(keys: np.ndarray, fps: np.ndarray, homes: np.ndarray, crowded: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of crowded anchors once for each pair of a block of homes and one of members that they belong to."""
    at = np.minimum(np.searchsorted(crowded, keys), len(crowded) - 1)
    hot = crowded[at] == keys
    if not hot.any():
        return keys, fps, homes
    out = [(keys[~hot], fps[~hot], homes[~hot])]
    key, fp, n = keys[hot], fps[hot], blocks[at[hot]]
    mine = ((fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)) % n
    for is_home in (False, True):
        rows = np.flatnonzero(homes[hot]) if is_home else np.arange(len(key))
        times = n[rows]
        row = np.repeat(rows, times)
        other = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        pair = mine[row] * n[row] + other if is_home else other * n[row] + mine[row]
        out.append((key[row] | (pair + 1) << ANCHOR_BITS, fp[row], np.full(len(row), is_home)))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _anchors(crowded: np.ndarray, blocks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, near = _code_tables()
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                rows = _replicas(batch.column(0).slice(at, 20_000).to_numpy(), home, near)
                if len(crowded):
                    rows = _dealt(*rows, crowded, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["anchor", "fp", "home"])

    return run


def crowded_anchors(nodes: DataFrame, members: int = MEMBERS) -> tuple[np.ndarray, np.ndarray]:
    """Anchors with more members than that (sorted), and in how many blocks they are dealt out.

    Members are counted only if some anchor is home to so many that one could
    have them.
    """
    none = np.zeros(0, np.int64)
    most = nodes.select("fp").mapInArrow(_homes, "anchor long").groupBy("anchor").count().agg(F.max("count")).first()[0]
    if (most or 0) * NEAR_ANCHORS <= members:
        return none, none
    counts = nodes.select("fp").mapInArrow(_anchors(none, none), "anchor long, fp long, home boolean").groupBy(F.col("anchor").alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    found = most_frequent(table(counts.where(F.col("n") > members), "crowded"), CROWDED).sort_by("unit")
    return found["unit"].to_numpy(), -(-found["n"].to_numpy() // members)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars that connect what the edges (u, v) connect."""
    ids, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = both[: len(u)], both[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _compare(key: np.ndarray, fp: np.ndarray, home: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of whole anchor groups, rows sorted by key."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    group = np.repeat(np.arange(len(start)), size)
    mine = np.flatnonzero(home)
    width = size[group[mine]]
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    end = np.cumsum(width)
    at = 0
    while at < len(mine):
        # homes whose pairs fit a block, one at least; a home meets at most its group's rows
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + BLOCK, "right")))
        w = width[at:to]
        left = np.repeat(mine[at:to], w)
        right = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w) + np.repeat(start[group[mine[at:to]]], w)
        differ = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64))
        linked = (differ <= most) & (fp[left] != fp[right])
        if linked.any():
            u, v = forest(fp[left[linked]], fp[right[linked]])
            us.append(u), vs.append(v)
        at = to
    return np.concatenate(us), np.concatenate(vs)


def _linker(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []  # rows of the last, unfinished group

        def linked(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            u, v = _compare(*(np.concatenate(x) for x in zip(*rows, strict=True)), most)
            if len(u):
                u, v = forest(u, v)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, home = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(key, key[-1]))
            if kept and (last or kept[-1][0][-1] != key[-1]):
                yield linked([*kept, (key[:last], fp[:last], home[:last])])
                kept = []
            elif last:
                yield linked([(key[:last], fp[:last], home[:last])])
            kept.append((key[last:], fp[last:], home[last:]))
        if kept:
            yield linked(kept)

    return run


def links(nodes: DataFrame, most: int = MOST_BITS, members: int = MEMBERS) -> DataFrame:
    """u, v: edges that connect all fingerprints linked at ``most`` bits or fewer.

    ``nodes`` has distinct fingerprints (fp).
    """
    if most > MOST_BITS:
        raise ValueError(f"the segments cover at most {MOST_BITS} differing bits")
    replicas = nodes.select("fp").mapInArrow(_anchors(*crowded_anchors(nodes, members)), "anchor long, fp long, home boolean")
    met = replicas.repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(_linker(most), "u long, v long").distinct()


def near_groups(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links, itself included.
    Null and empty texts have fingerprint zero and link as any other; equal
    fingerprints are one node, so copies are never compared with each other.
    Repeated rows stay; a null id takes its component's id, null if it has
    none; extra columns are ignored.
    """
    rows = table(fingerprints(docs), "fingerprints")
    nodes = table(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "nodes")
    roots = components(links(nodes, most))
    placed = nodes.join(roots, nodes["fp"] == roots["id"], "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    named = first_of_group(placed, "root", "first_doc").select(F.col("fp").alias("_fp"), F.col("first_id").alias("component_id"))
    return rows.join(named, rows["fp"] == named["_fp"]).select("doc_id", "fp", "component_id")


def later_rows(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """_row of every row of ``docs`` (doc_id, text, _row) but one of each near-duplicate component."""
    made = table(fingerprints(docs.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_made"), "fp"), "fingerprints")
    roots = components(links(table(made.select("fp").distinct(), "nodes"), most))
    ids = docs.select("doc_id", "_row")
    placed = made.join(ids, made["_made"] == ids["_row"]).select("doc_id", "_row", "fp")
    return later_of_group(placed.join(roots, placed["fp"] == roots["id"], "left").select("doc_id", "_row", F.coalesce("root", "fp").alias("root")), "root")
