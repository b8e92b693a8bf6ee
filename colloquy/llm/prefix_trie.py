"""Trie of conversation prefixes, from a Cartesian tree over sorted conversations.

Conversations are sorted by the digests of their turns. The length of the
common prefix of neighbours (LCP) says where paths of the trie part: node d of
a conversation is shared with the rows before it down to its LCP and lasts
until the next row with a smaller LCP. Each range of the sort is a block. In a
block a stack holds the Cartesian tree of the LCPs, one entry for a run of
depths with the same members (equal LCPs are one node, missing depths are
expanded as entries leave). What reaches over a block's edge is settled by
all-nearest-smaller-values over the blocks' minima: the part of a node in a
later block belongs to the nearest block before with a smaller minimum, and
parts are aggregated by that owner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Bytes of a turn's digest.
DIGEST = 32
#: Conversations of a block, about.
BLOCK_ROWS = 20_000


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of digest, size): each conversation's turns in order, texts as digests.

    Ties of a turn's number go by digest; null role or text is empty; rows
    without conv_id are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", digest.alias("digest"), F.char_length(text).alias("size")).alias("t"))
    each = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return each.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def with_shared_openings(ordered: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """conv_id, turns: the first h turns of conversation c - c % every, then c's own after its first h.

    h is the CRC-32 of the decimal id modulo ``most``; an absent opening
    conversation gives no turns.
    """
    base = ordered.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("opening"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rows = ordered.withColumn("h", h).join(base, ordered["conv_id"] - ordered["conv_id"] % every == base["base"], "left")
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return rows.select("conv_id", F.when(F.col("opening").isNull(), own).otherwise(F.concat(F.slice("opening", F.lit(1), F.col("h")), own)).alias("turns"))


def sorted_paths(rebuilt: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, path (its turns' digests, joined), sizes; in blocks by path, then conv_id."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    rows = table(rebuilt.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes")), "paths")
    blocks = max(1, -(-rows.count() // block_rows))
    return rows.repartitionByRange(blocks, "path", "conv_id").sortWithinPartitions("path", "conv_id")


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their start."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    if a[: high * DIGEST] == b[: high * DIGEST]:
        return high
    while low < high - 1:  # at least low are shared, high are not
        middle = (low + high) // 2
        if a[low * DIGEST : middle * DIGEST] == b[low * DIGEST : middle * DIGEST]:
            low = middle
        else:
            high = middle
    return low


class _Entry:
    """Depths above ``low`` to ``high`` of one path with the same members, so far."""

    __slots__ = ("children", "ends", "high", "least", "low", "n", "row", "shared", "sums", "twigs")

    def __init__(self, row: int, low: int, high: int, conv_id: int, sums: list[int]) -> None:
        self.row, self.low, self.high, self.sums = row, low, high, sums
        self.n, self.least, self.children, self.shared, self.twigs = 1, conv_id, 0, 0, 0
        self.ends: list[bytes] = [b"%d" % conv_id]


NODES = (
    "block int, row int, depth int, parent_row int, own_length int, closed boolean, n_convs long, conv_id long, n_children long, "
    "shared long, twigs long, before long, ends binary, first_path binary, last_path binary, least_lcp int, sizes array<int>"
)
_TYPES = pa.schema([
    ("block", pa.int32()), ("row", pa.int32()), ("depth", pa.int32()), ("parent_row", pa.int32()), ("own_length", pa.int32()), ("closed", pa.bool_()), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("n_children", pa.int64()),
    ("shared", pa.int64()), ("twigs", pa.int64()), ("before", pa.int64()), ("ends", pa.binary()), ("first_path", pa.binary()), ("last_path", pa.binary()), ("least_lcp", pa.int32()), ("sizes", pa.list_(pa.int32())),
])
#: Nodes that are handed on at once.
PART = 4096


class Block:
    """The Cartesian tree of one block's rows, taken one by one in order.

    The first row's LCP with the block before isn't known here: it is taken
    as -1, so all its depths, the root's too, are entries of this block, and
    those that belong to an earlier block are told apart later.
    """

    def __init__(self, number: int) -> None:
        self.number, self.rows, self.out = number, 0, []
        self.stack: list[_Entry] = []
        self.least_lcp: int | None = None
        self.first_path = self.path = b""
        self.first_sizes: list[int] = []

    def _leave(self, entry: _Entry, above: int, closed: bool) -> None:
        """Nodes of the top entry's depths over ``above``; the entry keeps the others."""
        below = self.stack[-2].row if len(self.stack) > 1 else None
        for depth in range(entry.high, above, -1):
            parent = entry.row if depth - 1 > entry.low else below
            bottom = depth == entry.high
            before = entry.sums[depth - 1] if depth else 0
            ends = b",".join(entry.ends) if bottom else b""
            own = len(entry.sums) - 1 if entry.row == 0 else None
            self.out.append((self.number, entry.row, depth, parent if depth else None, own, closed, entry.n, entry.least, entry.children if bottom else 1, entry.shared, entry.twigs, before, ends, None, None, None, None))
        entry.high, entry.children, entry.ends = above, 1, []

    def _pop(self, lcp: int, closed: bool) -> None:
        """Depths over ``lcp`` end; what left is added to what holds it."""
        while self.stack and self.stack[-1].high > lcp:
            top = self.stack[-1]
            self._leave(top, max(top.low, lcp), closed)
            if top.high > top.low:
                return
            self.stack.pop()
            if self.stack:
                under = self.stack[-1]
                under.n += top.n
                under.least = min(under.least, top.least)
                under.shared += top.shared
                under.twigs += top.twigs

    def add(self, conv_id: int, path: bytes, sizes: list[int]) -> None:
        length = len(sizes)
        sums = [0]
        for s in sizes:
            sums.append(sums[-1] + s)
        if not self.rows:
            self.first_path, self.first_sizes = path, sizes
            self.stack.append(_Entry(0, -1, length, conv_id, sums))
        else:
            lcp = _common(self.path, path)
            self.least_lcp = lcp if self.least_lcp is None else min(self.least_lcp, lcp)
            twig = lcp < len(self.path) // DIGEST
            self._pop(lcp, True)
            top = self.stack[-1]
            top.shared += sums[lcp]
            top.twigs += twig
            if length == lcp:
                top.n += 1
                top.least = min(top.least, conv_id)
                top.ends.append(b"%d" % conv_id)
            else:
                top.children += 1
                self.stack.append(_Entry(self.rows, lcp, length, conv_id, sums))
        self.rows += 1
        self.path = path

    def end(self) -> None:
        """What is still open, and the block's edges as a row of depth -1."""
        self._pop(-1, False)
        self.out.append((self.number, None, -1, None, None, None, self.rows, None, None, None, None, None, None, self.first_path, self.path, self.least_lcp, self.first_sizes))

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            columns = list(zip(*self.out, strict=True))
            self.out = []
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _TYPES, strict=True)], schema=_TYPES)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = Block(TaskContext.get().partitionId())
    for batch in batches:
        for conv_id, path, sizes in zip(batch["conv_id"].to_pylist(), batch["path"].to_pylist(), batch["sizes"].to_pylist(), strict=True):
            block.add(conv_id, path, sizes)
            if len(block.out) >= PART:
                yield from block.taken()
    if block.rows:
        block.end()
        yield from block.taken()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LCP of each block's first row with the last row before it."""
    for batch in batches:
        out = []
        for before, first, sizes in zip(batch["before"].to_pylist(), batch["first_path"].to_pylist(), batch["sizes"].to_pylist(), strict=True):
            lcp = -1 if before is None else _common(before, first)
            out.append((lcp, sum(sizes[: max(lcp, 0)]), int(before is not None and lcp < len(before) // DIGEST)))
        lcps, shared, twigs = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch["block"], batch["least_lcp"], pa.array(lcps, pa.int32()), pa.array(shared, pa.int64()), pa.array(twigs, pa.int64())], ["block", "least_lcp", "lcp", "shared", "twigs"])


def block_edges(parts: DataFrame) -> pa.Table:
    """block, lcp, shared, twigs, least_lcp of every block that has rows, in order; a row of numbers each."""
    edges = parts.where("depth = -1").select("block", "first_path", "last_path", "least_lcp", "sizes")
    numbers = sorted(r.block for r in edges.select("block").collect())
    before = parts.sparkSession.createDataFrame(list(zip(numbers[1:], numbers[:-1], strict=True)), "block int, previous int")
    last = edges.select(F.col("block").alias("previous"), F.col("last_path").alias("before"))
    rows = edges.drop("last_path").join(before, "block", "left").join(last, "previous", "left")
    found = rows.select("block", "least_lcp", "before", "first_path", "sizes").mapInArrow(_edges, "block int, least_lcp int, lcp int, shared long, twigs long")
    return found.toArrow().sort_by("block")


class Minima:
    """Nearest earlier block with a smaller minimum, by minima of 1, 2, 4, ... blocks."""

    def __init__(self, numbers: list[int], minima: list[int]) -> None:
        self.numbers = numbers
        self.at = {b: k for k, b in enumerate(numbers)}
        self.levels = [np.array(minima, np.int64)]
        while len(self.levels[-1]) > 1:
            m = self.levels[-1]
            self.levels.append(np.minimum.reduceat(m, np.arange(0, len(m), 2)))

    def before(self, block: int, depth: int) -> int:
        """The nearest block before ``block`` in which some LCP is smaller than ``depth``; it began the node."""
        k, level = self.at[block], 0
        while True:  # up, while no left neighbour holds a smaller value
            if k % 2 and self.levels[level][k - 1] < depth:
                k -= 1
                break
            k, level = k // 2, level + 1
        while level:  # down, to the rightmost smaller one
            level -= 1
            k = min(2 * k + 1, len(self.levels[level]) - 1)
            if self.levels[level][k] >= depth:
                k -= 1
        return self.numbers[k]


def _owned(held):
    """Parts on a block's edge with the block that owns them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lcps, minima = held.value
        for batch in batches:
            owner, first = [], []
            for block, row, depth in zip(batch["block"].to_pylist(), batch["row"].to_pylist(), batch["depth"].to_pylist(), strict=True):
                inherited = row == 0 and depth <= lcps[block]
                owner.append(minima.before(block, depth) if inherited else block)
                first.append(inherited)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(owner, pa.int32()), pa.array(first, pa.bool_())], [*batch.schema.names, "owner", "inherited"])

    return run


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's ids, whose parts come in order; only the running hash is held."""
    key, running = None, None
    for batch in batches:
        out = []
        for owner, depth, ends in zip(batch["owner"].to_pylist(), batch["depth"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            if (owner, depth) != key:
                if key is not None:
                    out.append((*key, running.hexdigest()))
                key, running = (owner, depth), hashlib.sha256(ends)
            else:
                running.update(b"," + ends)
        yield _ends_batch(out)
    if key is not None:
        yield _ends_batch([(*key, running.hexdigest())])


def _ends_batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    owner, depth, ends = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(owner, pa.int32()), pa.array(depth, pa.int32()), pa.array(ends, pa.string())], ["owner", "depth", "ends_sha256"])


#: Columns of a node beside what is computed from its sums.
NODE = ("block", "row", "depth", "parent_row", "conv_id", "n_convs", "n_children")


def _leaves(twigs: str) -> Column:
    """Rows that the next one doesn't go on from, and the last row."""
    return (F.col(twigs) + 1).alias("n_leaves")


def _saved(n: str, shared: str, before: str) -> Column:
    """Code points that a subtree's nodes share: those of repeated rows, without the ones above the node."""
    return (F.col(shared) - (F.col(n) - 1) * F.col(before)).alias("saved_tokens")


def nodes(rebuilt: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every trie node.

    ``rebuilt`` has conv_id and turns (digest, size). Blocks of about
    ``block_rows`` conversations are tasks that hold their stack and a batch;
    one row of numbers a block goes to the driver. Copies of a conversation
    spread over blocks. Without conversations there is no node.
    """
    spark = rebuilt.sparkSession
    parts = table(sorted_paths(rebuilt, block_rows).mapInArrow(_blocks, NODES), "trie-parts")
    edges = block_edges(parts)
    numbers, lcps, least = (edges[c].to_pylist() for c in ("block", "lcp", "least_lcp"))
    minima = Minima(numbers, [x if m is None else min(x, m) for x, m in zip(lcps, least, strict=True)])
    held = spark.sparkContext.broadcast((dict(zip(numbers, lcps, strict=True)), minima))
    at_start = spark.createDataFrame(edges.select(["block", "lcp", "shared", "twigs"]).rename_columns(["edge_block", "edge_lcp", "edge_shared", "edge_twigs"]))

    inner = parts.where("depth >= 0 AND closed AND row > 0")
    final = inner.select(*NODE, _leaves("twigs"), _saved("n_convs", "shared", "before"), F.sha2("ends", 256).alias("ends_sha256"))

    rim = parts.where("depth >= 0 AND NOT (closed AND row > 0)").drop("first_path", "last_path", "least_lcp", "sizes")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rim.schema.fields) + ", owner int, inherited boolean"
    owned = table(rim.mapInArrow(_owned(held), schema).join(F.broadcast(at_start), F.col("block") == F.col("edge_block")), "trie-rim")
    alone = owned.where("closed AND NOT inherited").select(*NODE, _leaves("twigs"), _saved("n_convs", "shared", "before"), F.sha2("ends", 256).alias("ends_sha256"))
    merged, others = _merged(owned.where("inherited OR NOT closed"))
    made = final.unionByName(alone).unionByName(merged)
    known = made.select("block", "row", "depth", "conv_id").unionByName(others)
    known = known.select(F.col("block").alias("in_block"), F.col("row").alias("in_row"), (F.col("depth") + 1).alias("below"), F.col("conv_id").alias("parent_conv_id"))
    rows = made.join(known, (F.col("block") == F.col("in_block")) & (F.col("parent_row") == F.col("in_row")) & (F.col("depth") == F.col("below")), "left")
    return rows.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _merged(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that reach over edges, and which of them the first rows of later blocks stand for (block, row, depth, conv_id).

    A first row's path goes on with a child of its own only below its LCP with
    the row before; above, that child belongs to an earlier block.
    """
    repeated = F.col("inherited") & (F.col("depth") < F.col("own_length")) & (F.col("depth") < F.col("edge_lcp"))
    inherited = lambda c: F.when(F.col("inherited"), F.col(c)).otherwise(0)
    whole = pieces.groupBy("owner", "depth").agg(
        F.max(F.when(~F.col("inherited"), F.struct("row", "parent_row"))).alias("first"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum(F.col("n_children") - repeated.cast("int")).alias("n_children"),
        F.sum(F.col("shared") + inherited("edge_shared")).alias("shared"), F.sum(F.col("twigs") + inherited("edge_twigs")).alias("twigs"), F.max("before").alias("before"),
    )
    ended = pieces.where("length(ends) > 0").select("owner", "depth", "block", "ends").repartition("owner", "depth").sortWithinPartitions("owner", "depth", "block")
    ends = ended.mapInArrow(_joined_ends, "owner int, depth int, ends_sha256 string")
    whole = table(whole.join(ends, ["owner", "depth"], "left"), "trie-merged")
    none = hashlib.sha256(b"").hexdigest()
    nodes_ = whole.select(
        F.col("owner").alias("block"), "first.row", "depth", "first.parent_row", "conv_id", "n_convs", "n_children", _leaves("twigs"), _saved("n_convs", "shared", "before"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )
    stood_for = pieces.where("inherited").select("block", "row", "owner", "depth").join(whole.select("owner", "depth", "conv_id"), ["owner", "depth"]).select("block", "row", "depth", "conv_id")
    return nodes_, stood_for


def prefix_trie(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The trie's nodes (see ``nodes``) of conversations (conv_id, turn, role, text) with shared openings.

    Null turns come first, ties of a turn go by digest; null role or text is
    empty; rows without conv_id are left out; repeated rows are turns of their
    own; copies are members of one node each; texts of any length count whole;
    an empty table has no node; extra columns are ignored. A conversation's
    digests (32 bytes a turn) are held by one task.
    """
    return nodes(with_shared_openings(ordered_turns(conversations)), block_rows)
