"""An FM-index over word sequences, searched for many patterns in lock-step.

The Burrows-Wheeler transform is kept as a wavelet matrix: one bit plane per
bit of a symbol with a rank directory, about log2(alphabet) bits a word. A
backward step maps the two bounds of a suffix interval through the planes; all
patterns take their step at once, in numpy.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)
        self.zeros = len(bits) - int(ones.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.levels: list[Bits] = []
        self.bits = max(1, int(alphabet - 1).bit_length())
        for level in reversed(range(self.bits)):
            bit = (symbols >> level & 1).astype(bool)
            self.levels.append(Bits(bit))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        c = np.arange(alphabet)
        self.start = self._map(c, np.zeros(alphabet, np.int64))

    def _map(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, plane in zip(reversed(range(self.bits)), self.levels, strict=True):
            ones = plane.rank(i)
            i = np.where(c >> level & 1, plane.zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c before position i."""
        return self._map(c, i) - self.start[c]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; equal text parts must end in distinct symbols."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        next_ = np.zeros(n, np.int64)
        next_[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + next_
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        if new[order[-1]] == n - 1:
            return order
        rank, step = new, step * 2


class FMIndex:
    """Index of texts given one after the other, each a list of symbols >= 1."""

    def __init__(self, texts: list[np.ndarray], alphabet: int) -> None:
        count = len(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(lengths + 1) - (lengths + 1)
        whole = np.zeros(int(lengths.sum()) + count, np.int64)
        ends = self.begin + lengths
        inside = np.ones(len(whole), bool)
        inside[ends] = False
        whole[inside] = np.concatenate([*texts, np.zeros(0, np.int64)])
        # each text ends in a symbol of its own, below all words
        order = suffix_array(np.where(inside, whole + count, np.cumsum(~inside) - 1))
        self.wavelet = WaveletMatrix(whole[order - 1], alphabet)
        occurrences = np.bincount(whole, minlength=alphabet)
        self.first = np.cumsum(occurrences) - occurrences
        self.size = len(whole)
        self.lowest = [order.astype(np.int32)]
        width = 1
        while 2 * width <= self.size:
            last = self.lowest[-1]
            self.lowest.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of patterns with symbol c put before them."""
        both = self.first[np.r_[c, c]] + self.wavelet.rank(np.r_[c, c], np.r_[low, high])
        return both[: len(c)], both[len(c) :]

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """First place in the text among the suffixes of each (non-empty) interval."""
        level = np.log2(high - low).astype(np.int64)
        out = np.zeros(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            table = self.lowest[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        return out

    def matches(self, texts: list[np.ndarray], own: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of maximal matches of at least ``least`` symbols.

        Each text is streamed from its end. A match counts if it also starts
        before the text's own place: ``own`` has the place of its first symbol.
        Where it can't be extended by a symbol to the left, the next candidate
        ends just before the shortest match that would hold that symbol.
        """
        lengths = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(lengths) - lengths
        words = np.concatenate([*texts, np.zeros(0, np.int64)])
        lane = np.flatnonzero(lengths >= least)
        end = lengths[lane].copy()
        at = end.copy()
        low, high = np.zeros(len(lane), np.int64), np.full(len(lane), self.size)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(lane):
            new_low, new_high = self.extend(words[begin[lane] + at - 1], low, high)
            good = new_high > new_low
            where = np.flatnonzero(good)
            good[where] = self.earliest(new_low[where], new_high[where]) < own[lane[where]] + at[where] - 1
            at = at - good
            low, high = np.where(good, new_low, low), np.where(good, new_high, high)
            stop = ~good | (at == 0)
            hit = stop & (end - at >= least)
            if hit.any():
                found.append((lane[hit], at[hit], end[hit]))
            again = np.minimum(end - 1, at + least - 1)
            end = np.where(stop, again, end)
            low, high = np.where(stop, 0, low), np.where(stop, self.size, high)
            done = stop & ((at == 0) | (end < least))
            at = np.where(stop, end, at)
            if done.any():
                on = ~done
                lane, end, at, low, high = lane[on], end[on], at[on], low[on], high[on]
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
