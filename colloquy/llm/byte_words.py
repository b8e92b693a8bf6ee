"""Words of Arrow string columns, found and hashed in numpy without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes handled at once; longer texts are cut into overlapping pieces.
CHUNK = 1 << 19
#: Longer words are hashed one by one.
LONG_WORD = 4096
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
#: Lower bytes of a 64-bit word, by their number.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


#: Per half of a hash: what is added to and multiplied with each eight bytes.
_KEYS = mix(np.arange(1, 4 * (LONG_WORD // 8) + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)).reshape(2, 2, -1)
_KEYS[:, 1] |= _U(1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its texts; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of texts that lie between these offsets of ``data``."""
    word = ~_IS_SPACE[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = word[edges]
    ends[edges - 1] = word[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each word, a row each.

    Eight bytes at a time are mixed, multiplied with a key of their place and
    summed; the two halves take different keys.
    """
    padded = np.zeros(len(data) // 8 + 3, _U)
    padded.view(np.uint8)[: len(data)] = data
    length = end - start
    out = np.stack([mix(length.astype(_U) + _KEYS[k, 0, 0]) for k in range(2)])
    which = np.arange(len(start))
    for lane in range(min(int(length.max(initial=0)), LONG_WORD) // 8 + 1):
        if lane:
            which = which[length[which] > 8 * lane]
        if not len(which):
            break
        at = start[which] + 8 * lane
        shift = ((at & 7) << 3).astype(_U)
        cell = at >> 3
        eight = padded[cell] >> shift | padded[cell + 1] << _U(1) << (_U(63) - shift)
        eight &= _LOW_BYTES[np.minimum(length[which] - 8 * lane, 8)]
        if lane < LONG_WORD // 8:
            for k in range(2):
                part = mix(eight + _KEYS[k, 0, lane]) * _KEYS[k, 1, lane]
                if lane:
                    out[k, which] += part
                else:
                    out[k] += part
    for w in np.flatnonzero(length > LONG_WORD).tolist():
        out[:, w] = np.frombuffer(xxhash.xxh3_128_digest(data[start[w] : end[w]].tobytes()), "<u8")
    return out


def pieces(column: pa.Array, overlap: int, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, number of its first word, bytes, offsets) of parts of a column.

    A part holds whole texts, or words of one text of more than ``size`` bytes;
    consecutive parts of a text share ``overlap`` words.
    """
    data, offsets = buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        to = max(int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1, row + 1)
        if offsets[to] - offsets[row] <= size:
            yield row, 0, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        else:
            yield from ((row, *x) for x in _parts(data[offsets[row] : offsets[to]], overlap, size))
        row = to


def _parts(text: np.ndarray, overlap: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    at, first, reach = 0, 0, size
    while True:
        stop = at + reach
        while stop < len(text) and not _IS_SPACE[text[stop]]:
            space = np.flatnonzero(_IS_SPACE[text[stop : stop + size]])
            stop += int(space[0]) if len(space) else size
        part = text[at:stop]
        whole = np.array([0, len(part)], np.int64)
        if stop >= len(text):
            yield first, part, whole
            return
        start, _ = bounds(part, whole)
        if len(start) <= overlap:  # very long words: a longer part
            reach *= 2
            continue
        yield first, part, whole
        at += int(start[len(start) - overlap]) if overlap else len(part)
        first += len(start) - overlap
        reach = size
