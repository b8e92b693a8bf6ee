"""Token counts without token ids: pieces per distinct pre-token, joined.

The tokenizer lower-cases, drops white space and never merges across the
boundaries of its pre-tokenizer, so the number of tokens of a text is the sum
over its pre-tokens of the pieces of each. Pieces are counted once per
distinct pre-token of the whole corpus. A fixed number of the most frequent
pre-tokens (``hot``) is broadcast, the rest is joined by the pre-token itself.
Both ways are exact; the split only keeps frequent keys out of the shuffle.
"""

from __future__ import annotations

import functools
import os
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, LONGEST_UNIT, NUMBERS, OTHER, WORD, most_frequent, row_ids, table

#: Pre-tokens in the broadcast table: at most 2^17 strings of at most 64 bytes, whatever the input.
HOT = 1 << 17
#: A task's counter is emitted and emptied at this many entries.
FLUSH = 200_000

#: The tokenizer's own split pattern, over the characters of the fast path.
_PRE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")
_SPECIAL = "<|"


def pre_tokens(text: str | None) -> list[str]:
    """Pre-tokens of a text, or whole words where the fast path can't tell.

    A word with characters outside the fast path, or with something like a
    special token, is one unit: the library itself counts its pieces.
    """
    if not text:
        return []
    if _SPECIAL not in text and not OTHER.search(text):
        return _PRE.findall(text.lower())
    units: list[str] = []
    for word in WORD.findall(text):
        if _SPECIAL in word or OTHER.search(word):
            units.append(word)
        else:
            units += _PRE.findall(word.lower())
    return units


def _corpus_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["unit", "n"])

    for batch in batches:
        for text in batch.column(0):
            counts.update(pre_tokens(text.as_py()))
            if len(counts) > FLUSH:
                yield out()
                counts.clear()
    yield out()


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str):
    """The tokenizer, loaded once per worker process; it starts no threads beside the task's own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _piece_counter(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            units = batch.column(0).to_pylist()
            pieces = [len(e.ids) for k in range(0, len(units), 2000) for e in tokenizer.encode_batch(units[k : k + 2000], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.int64())], ["unit", "n", "pieces"])

    return run


_FREQUENCIES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("unit", pa.string()), ("freq", pa.int64())])
#: Rows that a task holds before it hands them on.
HELD = 50_000


def _document_frequencies(hot):
    """A row per document with the pieces of its hot units, and one per document and other unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = hot.value
        for batch in batches:
            whole: list[tuple[int, int | None, int, int]] = []
            row: list[int] = []
            unit: list[str] = []
            freq: list[int] = []

            def out(whole=whole, row=row, unit=unit, freq=freq) -> Iterator[pa.RecordBatch]:
                rows, ids, size, known = zip(*whole, strict=True)
                # a key of its own, which no unit equals, so that these rows spread in the join
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((rows, ids, size, known, [f" {r}" for r in rows], [0] * len(rows)), _FREQUENCIES, strict=True)], schema=_FREQUENCIES)
                none = pa.nulls(len(row), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), none, none, pa.array(np.zeros(len(row), np.int64)), pa.array(unit, pa.string()), pa.array(freq, pa.int64())], schema=_FREQUENCIES)
                for held in (whole, row, unit, freq):
                    held.clear()

            for r, d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py() or ""
                known = 0
                for u, f in Counter(pre_tokens(text)).items():
                    n = pieces.get(u)
                    if n is None:
                        row.append(r), unit.append(u), freq.append(f)
                    else:
                        known += n * f
                whole.append((r, d, len(text.encode()), known))
                if len(whole) + len(row) >= HELD:
                    yield from out()
            if whole:
                yield from out()

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, hot_size: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of ``docs`` (doc_id, text).

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows and repeated
    or null ids each give their own row; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select("text")
    counts = texts.mapInArrow(_corpus_counts, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    vocabulary = table(counts.mapInArrow(_piece_counter(tokenizer_path), "unit string, n long, pieces long"), "pieces")
    top = most_frequent(vocabulary, hot_size, LONGEST_UNIT)
    hot = spark.sparkContext.broadcast({sys.intern(u): n for u, n in zip(top["unit"].to_pylist(), top["pieces"].to_pylist(), strict=True)})
    pairs = row_ids(docs.select("doc_id", "text")).select("_row", "doc_id", "text").mapInArrow(_document_frequencies(hot), "row long, doc_id long, n_bytes long, known long, unit string, freq long")
    joined = pairs.join(vocabulary.select("unit", "pieces").hint("merge"), "unit", "left")
    return (
        joined.groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("known") + F.col("freq") * F.coalesce("pieces", F.lit(0))).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens")
    )
