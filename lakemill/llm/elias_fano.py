"""Elias-Fano coding of monotone numbers, and a two-level n-gram trie of such sequences.

Any number of a sequence is read by itself: its high part by a select on a bit set with a count every 64 bits, its low part from
packed words. All reads are of arrays of places at a time. A trie is one string of bytes, which a task maps into memory and reads in place.
"""

from __future__ import annotations

import mmap

import numpy as np

_ONE, _63 = np.uint64(1), np.uint64(63)
#: Numbers that are coded at a time.
_BLOCK = 1 << 16


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest ``bits`` bits of numbers end to end in 64-bit words, and a word to spare."""
    out = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    for a in range(0, len(values) if bits else 0, _BLOCK):
        some = values[a : a + _BLOCK] & np.uint64((1 << bits) - 1)
        at = np.arange(a, a + len(some), dtype=np.uint64) * np.uint64(bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & _63
        first = _firsts(word)
        out[word[first]] |= np.bitwise_or.reduceat(some << shift, first)
        over = np.flatnonzero(shift + np.uint64(bits) > np.uint64(64))  # a word takes at most one number's rest
        out[word[over] + 1] |= some[over] >> (np.uint64(64) - shift[over])
    return out


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers in about ``2 + log2(range / n)`` bits each, and a half for the counts."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        self.before = np.zeros(len(high) + 1, np.int64)
        np.cumsum(np.bitwise_count(high), out=self.before[1:])

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64, copy=False)
        n = len(values)
        span = int(values[-1]) + 1 if n else 1
        bits = max(0, (span // max(n, 1)).bit_length() - 1)
        high = np.zeros(((int(values[-1]) >> bits) + n - 1) // 64 + 1 if n else 0, np.uint64)
        for a in range(0, n, _BLOCK):
            some = values[a : a + _BLOCK]
            ones = (some >> np.uint64(bits)) + np.arange(a, a + len(some), dtype=np.uint64)
            word = (ones >> np.uint64(6)).astype(np.int64)
            first = _firsts(word)
            high[word[first]] |= np.bitwise_or.reduceat(_ONE << (ones & _63), first)
        return cls(n, bits, _pack(values, bits), high)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The numbers at these places."""
        word = np.searchsorted(self.before, at, side="right") - 1
        rest, bits = at - self.before[word], self.high[word]
        place = np.zeros(len(at), np.int64)
        for half in (32, 16, 8, 4, 2, 1):  # the word's one with ``rest`` ones before it
            ones = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            up = rest >= ones
            rest = rest - ones * up
            place += half * up
            bits = np.where(up, bits >> np.uint64(half), bits)
        out = (word * 64 + place - at).astype(np.uint64) << np.uint64(self.bits)
        if self.bits:
            bit = at.astype(np.uint64) * np.uint64(self.bits)
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & _63
            low = self.low[word] >> shift
            low |= np.where(shift + np.uint64(self.bits) > np.uint64(64), self.low[word + 1] << ((np.uint64(64) - shift) & _63), np.uint64(0))
            out |= low & np.uint64((1 << self.bits) - 1)
        return out

    def successors(self, wanted: np.ndarray, block: int = _BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """For ascending ``wanted`` the place of the first number not less, and whether it is equal; reads the whole sequence once, a block at a time."""
        at, equal = np.full(len(wanted), self.n, np.int64), np.zeros(len(wanted), bool)
        done = 0
        for a in range(0, self.n, block):
            values = self.get(np.arange(a, min(self.n, a + block)))
            end = int(np.searchsorted(wanted, values[-1], side="right"))
            if end > done:
                found = np.searchsorted(values, wanted[done:end])
                at[done:end] = a + found
                equal[done:end] = values[found] == wanted[done:end]
                done = end
        return at, equal

    def successors_within(self, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each wanted number the place of the first one not less between its own two places, by halving, and whether it is equal."""
        low, high = begin.copy(), end.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            less = self.get(middle) < wanted[live]
            low[live[less]] = middle[less] + 1
            high[live[~less]] = middle[~less]
            live = live[low[live] < high[live]]
        equal = np.zeros(len(wanted), bool)
        inside = np.flatnonzero(low < end)
        equal[inside] = self.get(low[inside]) == wanted[inside]
        return low, equal


def quantised(values: np.ndarray, levels: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """One-byte codes, and the mean of the values of each code."""
    if not len(values):
        return np.empty(0, np.uint8), np.zeros(1)
    low, high = float(values.min()), float(values.max())
    codes = np.minimum((values - low) * (levels / max(high - low, 1e-12)), levels - 1).astype(np.uint8)
    n = np.bincount(codes, minlength=levels)
    return codes, np.bincount(codes, values, minlength=levels) / np.maximum(n, 1)


class BigramTrie:
    """Contexts with their counts, pointers to their successors, successors relative to their context, and coded probabilities.

    The levels are monotone: contexts and the vocabulary by value, counts and pointers as running sums, and a successor as
    ``context number * vocabulary + word number``. A word is looked for between its context's pointer and the next one, nowhere else.
    """

    _LEVELS = ("contexts", "sums", "words", "pointers", "successors")

    def __init__(self, contexts: EliasFano, sums: EliasFano, words: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray, means: np.ndarray):
        self.contexts, self.sums, self.words, self.pointers, self.successors, self.codes, self.means = contexts, sums, words, pointers, successors, codes, means

    @classmethod
    def of(cls, context: np.ndarray, word: np.ndarray, value: np.ndarray, counts: np.ndarray) -> BigramTrie:
        """The first three by ascending (context, word), without repeats; ``counts`` has a number per distinct context."""
        first = _firsts(context)
        vocabulary = np.unique(word)
        key = np.repeat(np.arange(len(first), dtype=np.uint64) * np.uint64(max(1, len(vocabulary))), np.diff(np.append(first, len(context))))
        for a in range(0, len(word), _BLOCK):
            key[a : a + _BLOCK] += np.searchsorted(vocabulary, word[a : a + _BLOCK]).astype(np.uint64)
        sums = np.append(0, np.cumsum(counts, dtype=np.int64))
        return cls(*(EliasFano.of(x) for x in (context[first], sums, vocabulary, np.append(first, len(context)), key)), *quantised(value))

    def to_bytes(self) -> bytes:
        levels = [getattr(self, k) for k in self._LEVELS]
        arrays = [x for level in levels for x in (level.low, level.high)] + [self.means, self.codes]
        head = [x for level in levels for x in (level.n, level.bits)] + [len(x) for x in arrays]
        return b"".join([np.array(head, np.int64).tobytes(), *(x.tobytes() for x in arrays)])

    @classmethod
    def mapped(cls, raw: bytes) -> BigramTrie:
        """A trie whose levels are read in place from an anonymous memory map: a cluster's shared folder is no path of the machine."""
        held = mmap.mmap(-1, len(raw))
        held.write(raw)
        size = 2 * len(cls._LEVELS)
        head = np.frombuffer(held, np.int64, 2 * size + 2).tolist()
        arrays, at = [], 8 * len(head)
        for k, n in enumerate(head[size:]):
            kind = np.uint64 if k < size else np.float64 if k == size else np.uint8
            arrays.append(np.frombuffer(held, kind, n, at) if n else np.empty(0, kind))
            at += arrays[-1].nbytes
        return cls(*(EliasFano(head[2 * i], head[2 * i + 1], arrays[2 * i], arrays[2 * i + 1]) for i in range(len(cls._LEVELS))), arrays[-1], arrays[-2])

    def find(self, context: np.ndarray, word: np.ndarray, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For queries by ascending (context, word): the context's count, whether it has the word, and the word's value."""
        first = _firsts(context)
        at, known = self.contexts.successors(context[first])
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
        counts = np.zeros(len(first), np.int64)
        counts[known] = (self.sums.get(at[known] + 1) - self.sums.get(at[known])).astype(np.int64)
        begin, end = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        begin[known], end[known] = (self.pointers.get(at[known] + k).astype(np.int64) for k in (0, 1))
        names, again = np.unique(word, return_inverse=True)
        number, held = self.words.successors(names)
        has, out = np.zeros(len(context), bool), np.zeros(len(context))
        ask = np.flatnonzero(known[of] & held[again])
        for a in range(0, len(ask), step):
            some = ask[a : a + step]
            c = of[some]
            key = at[c].astype(np.uint64) * np.uint64(max(1, self.words.n)) + number[again[some]].astype(np.uint64)
            place, equal = self.successors.successors_within(begin[c], end[c], key)
            has[some[equal]], out[some[equal]] = True, self.means[self.codes[place[equal]]]
        return counts[of], has, out
