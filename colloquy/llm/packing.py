"""Harmonic packing of tokenised documents into fixed-size sequences.

Each task packs groups of a bounded number of tokens on its own, without
seeing other tasks. Full-length slices are sequences of their own. The tails
are put into reciprocal-capacity classes: class k holds tails of
(capacity/(k+1), capacity/k] ids, and each of its sequences takes exactly k
whole tails. What is left of a sequence is then filled with slices of the
group's shortest tails, which are set aside for it: as documents may be cut
anywhere, only one sequence per group needs padding.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import LETTERS, NUMBERS, OTHER

CAPACITY = 2048
END_ID = 1
#: Tails of at most capacity/CLASSES ids share the last class.
CLASSES = 64
#: A task packs what it has at this many ids (8 MB of them).
GROUP_IDS = 4 << 20
#: Encoded units of a generation; two generations are kept, what is used moves to the younger.
CACHE = 300_000
#: The pre-tokenizer's own split pattern, for texts of well-known characters.
_PRE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\\s{LETTERS}{NUMBERS}]+|\\s+(?!\\S)|\\s+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(others)}


_LETTERS_OF_BYTES = _byte_letters()


class _PreTokens(dict):
    """pre-token -> bytes of its ids, from the library's model; two generations are kept."""

    def __init__(self, model, code: str) -> None:
        self.model, self.code = model, code
        self.older: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.older.get(unit)
        if ids is None:
            letters = unit.encode().decode("latin-1").translate(_LETTERS_OF_BYTES)
            ids = array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(self) > CACHE:
            self.older = dict(self)
            self.clear()
        self[unit] = ids
        return ids


class UnitEncoder:
    """Ids of whole texts through a byte-level BPE tokenizer, by cached pre-tokens.

    The ids of a text are those of its pre-tokens, one after the other. Texts
    with unusual characters, or that may hold special tokens, go through the
    library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.cache = _PreTokens(self.tokenizer.model, "H" if self.dtype is np.uint16 else "I")

    def encode(self, text: str) -> np.ndarray:
        if "<|" in text or OTHER.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
        return np.frombuffer(b"".join(map(self.cache.__getitem__, _PRE.findall(text))), self.dtype)


def pack(lengths: np.ndarray, capacity: int = CAPACITY, classes: int = CLASSES) -> tuple[np.ndarray, ...]:
    """Pieces of documents with these lengths: (document, start, length, sequence, offset).

    Sequences are numbered from 0; all but one are full. Documents without ids
    get no piece.
    """
    lengths = np.asarray(lengths, np.int64)
    full, tail = lengths // capacity, lengths % capacity
    doc = np.repeat(np.arange(len(lengths)), full)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
    pieces = [np.stack([doc, nth * capacity, np.full(len(doc), capacity), np.arange(len(doc)), np.zeros(len(doc), np.int64)])]
    sequences = len(doc)

    order = np.argsort(-tail, kind="stable")
    order = order[tail[order] > 0]
    r = tail[order]
    if len(r):
        k = np.minimum(capacity // r, classes)
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        place = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))  # within the class
        opened = np.cumsum(place % k == 0)
        whole = int(np.searchsorted(opened * capacity, r.sum(), "right"))  # the rest fills up what these leave
        bins = opened[:whole] - 1
        before = np.cumsum(r[:whole]) - r[:whole]
        offset = before - before[np.searchsorted(bins, bins)] if whole else before
        n_bins = int(opened[whole - 1]) if whole else 0
        used = np.bincount(bins, r[:whole], n_bins).astype(np.int64)
        base = (full * capacity)[order]
        pieces.append(np.stack([order[:whole], base[:whole], r[:whole], sequences + bins, offset]))
        fill, fill_doc, fill_base = r[whole:], order[whole:], base[whole:]
        if total := int(fill.sum()):
            holes = capacity - used
            open_bins = np.flatnonzero(holes)
            more = max(0, -(-(total - int(holes.sum())) // capacity))
            slots = np.r_[holes[open_bins], np.full(more, capacity)]
            slot_bin = np.r_[open_bins, n_bins + np.arange(more)]
            slot_offset = np.r_[used[open_bins], np.zeros(more, np.int64)]
            slot_end, doc_end = np.cumsum(slots), np.cumsum(fill)
            ends = np.unique(np.r_[slot_end[slot_end < total], doc_end])
            begins = np.r_[0, ends[:-1]]
            s, d = np.searchsorted(slot_end, begins, "right"), np.searchsorted(doc_end, begins, "right")
            pieces.append(np.stack([fill_doc[d], fill_base[d] + begins - (doc_end - fill)[d], ends - begins, sequences + slot_bin[s], slot_offset[s] + begins - (slot_end - slots)[s]]))
    return tuple(np.concatenate(pieces, axis=1))


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder_for(path: str) -> UnitEncoder:
    """The process's encoder of a tokenizer file; its cache outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def _packer(tokenizer_path: str, capacity: int, group_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer_path)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held
            doc, start, length, seq, offset = pack(np.array([len(x) for x in ids], np.int64), capacity)
            crc = [zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            sizes = np.array([len(x) for x in ids], np.int64)
            out = pa.RecordBatch.from_arrays(
                [pa.array([doc_ids[d] for d in doc.tolist()], pa.int64()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[doc]), pa.array(seq + sequence), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += int(seq.max()) + 1
            doc_ids.clear(), ids.clear()
            held = 0
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    x = encoder.encode(t or "")
                    doc_ids.append(d)
                    ids.append(np.append(x, encoder.dtype(END_ID)))
                    held += len(x) + 1
                if held >= group_ids:
                    yield flush()
        if ids:
            yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group_ids: int = GROUP_IDS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset per piece.

    Every row of ``docs`` (doc_id, text) is tokenised whole and ends with id 1;
    a null text has that id alone. Repeated rows are packed each on its own;
    extra columns are ignored. A sequence holds ids of one task only, and its
    number starts from the task's partition.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _packer(tokenizer_path, capacity, group_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
