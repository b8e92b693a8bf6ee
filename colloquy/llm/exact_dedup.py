"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its last bytes says so, hence equal
passages give equal chunks wherever they stand. Chunks are deduplicated to
identifiers (their 128-bit digest), each verified by comparing the bytes of all
chunks that share it. Documents are then compared by their ordered identifier
lists alone: document texts are never shuffled, and of chunks only one copy per
task.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_of_group, later_of_group, table

#: Cut when this many low bits of the rolling hash are zero: about 1 kB.
CUT_BITS = 10
MIN_CHUNK = 256
MAX_CHUNK = 8192
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], np.uint32)
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def normalise(text: str | None) -> bytes:
    """UTF-8 with each white-space run as one space; null is empty."""
    data = (text or "").encode().translate(_SPACES)
    while b"  " in data:
        data = data.replace(b"        ", b" ").replace(b"  ", b" ")
    return data


def chunks(data: bytes) -> list[bytes]:
    """Content-defined chunks whose concatenation is ``data``."""
    n = len(data)
    if n <= 2 * MIN_CHUNK:
        return [data]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):  # after these, h covers the last 16 bytes
        h[step:] += h[:-step] << np.uint32(step)
    cuts = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    parts, start = [], 0
    for cut in [*cuts.tolist(), n]:
        while cut - start > MAX_CHUNK:
            parts.append(data[start : start + MAX_CHUNK])
            start += MAX_CHUNK
        if cut - start >= MIN_CHUNK or cut == n > start:
            parts.append(data[start:cut])
            start = cut
    return parts


def _distinct_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[tuple[bytes, bytes], None] = {}
        for text in batch.column(0):
            for c in chunks(normalise(text.as_py())):
                found[xxhash.xxh3_128_digest(c), c] = None
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.binary()), pa.array([c for _, c in found], pa.binary())], ["digest", "chunk"])


def _recipes(colliding: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recipe, sha = [], []
            for text in batch.column(1):
                data = normalise(text.as_py())
                ids = []
                for c in chunks(data):
                    d = xxhash.xxh3_128_digest(c)
                    # an identifier that isn't unique gives way to the bytes
                    ids.append(b"\x01" + d if d not in colliding else b"\x00" + base64.b64encode(c) + b"\x00")
                recipe.append(b"".join(ids))
                sha.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(recipe, pa.binary()), pa.array(sha, pa.string())], ["doc_id", "recipe", "text_sha256"])

    return run


def chunk_collisions(docs: DataFrame) -> DataFrame:
    """Digests that stand for more than one chunk: expected to be none."""
    found = docs.select("text").mapInArrow(_distinct_chunks, "digest binary, chunk binary")
    return found.groupBy("digest").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low <> high").select("digest")


def recipes(docs: DataFrame, most_collisions: int = 10_000) -> DataFrame:
    """doc_id, recipe (its verified chunk identifiers in order), text_sha256.

    Digests that failed verification go to the tasks as a set. More than
    ``most_collisions`` would mean that the hash itself is broken: an error.
    """
    bad = [bytes(r.digest) for r in chunk_collisions(docs).limit(most_collisions + 1).collect()]
    if len(bad) > most_collisions:
        raise ValueError("too many chunk digests collide")
    return docs.select("doc_id", "text").mapInArrow(_recipes(frozenset(bad)), "doc_id long, recipe binary, text_sha256 string")


def later_rows(docs: DataFrame) -> DataFrame:
    """_row of every row of ``docs`` (doc_id, text, _row) but one of each group of equal texts."""
    # recipes carry one long a row: the row's key, by which doc_id comes back
    made = table(recipes(docs.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_made"), "recipe"), "recipes")
    ids = docs.select("doc_id", "_row")
    return later_of_group(made.join(ids, made["_made"] == ids["_row"]).select("doc_id", "_row", "recipe"), "recipe")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal when identical after each white-space run became one
    space; null is empty. The smallest doc_id of a group stays. Rows that
    repeat that doc_id with an equal text are kept alike; a null doc_id is
    kept only in a group that has no other id. Extra columns are ignored.
    """
    rows = table(recipes(docs), "recipes")
    return first_of_group(rows, "recipe", "doc_id").select("doc_id", F.col("first_id").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(F.col("first_id")).alias("kept"), "text_sha256")
