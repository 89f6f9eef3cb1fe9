"""Elias-Fano sequences and a three-level n-gram trie over them, for numpy.

A trie is one flat buffer of 8-byte aligned sections, so it can be mapped from a file;
all look-ups take whole arrays of queries.
"""

from __future__ import annotations

import mmap
import tempfile
from dataclasses import dataclass

import numpy as np

_U = np.uint64


#: Values that are packed at a time; a multiple of 64, so that each part begins with a word.
_PART = 1 << 16


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of each value, one after another, in words."""
    n = len(values)
    if not width or not n:
        return np.zeros(1, _U)
    out = np.zeros(n * width // 64 + 2, _U)
    for start in range(0, n, _PART):
        part = values[start : start + _PART] & _U((1 << width) - 1)
        at = np.arange(start, start + len(part), dtype=_U) * _U(width)
        word, bit = (at >> _U(6)).astype(np.int64), at & _U(63)
        first = np.flatnonzero(np.diff(word, prepend=-1))  # values that begin in one word lie together
        out[word[first]] |= np.bitwise_or.reduceat(part << bit, first)
        spill = np.flatnonzero(bit + _U(width) > _U(64))  # at most one for each word
        out[word[spill] + 1] |= part[spill] >> (_U(64) - bit[spill])
    return out


def _unary(values: np.ndarray, width: int, n: int) -> np.ndarray:
    """A set bit at (value >> width) + i for each value, and zeros up to past the last."""
    top = int(values[-1]) >> width if n else 0
    bits = np.zeros(-(-(n + top + 2) // 64) * 64, bool)
    for start in range(0, n, _PART):
        part = values[start : start + _PART]
        bits[(part >> _U(width)).astype(np.int64) + np.arange(start, start + len(part))] = True
    return np.packbits(bits, bitorder="little").view(_U)


def _get_bits(words: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(index), _U)
    at = index.astype(_U) * _U(width)
    word, bit = (at >> _U(6)).astype(np.int64), at & _U(63)
    high = np.where(bit > 0, words[word + 1] << ((_U(64) - bit) & _U(63)), _U(0))
    return ((words[word] >> bit) | high) & _U((1 << width) - 1)


@dataclass
class EliasFano:
    """A sorted sequence of n integers below 2^64: `width` low bits of each as they are,
    the high parts as a unary bit string."""

    n: int
    width: int
    low: np.ndarray
    high: np.ndarray  # bit high(i) + i is set for each i
    zeros: np.ndarray  # zeros before each word of high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.ascontiguousarray(values, _U)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, ((top + 1) // max(1, n)).bit_length() - 1)
        high = _unary(values, width, n)
        return cls(n, width, _pack_bits(values, width), high, cls._zeros(high))

    @staticmethod
    def _zeros(high: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))])

    def sections(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], _U), self.low, self.high]

    @classmethod
    def mapped(cls, head: np.ndarray, low: np.ndarray, high: np.ndarray) -> EliasFano:
        return cls(int(head[0]), int(head[1]), low, high, cls._zeros(high))

    def _before(self, part: np.ndarray) -> np.ndarray:
        """How many values have a high part below each of `part`."""
        limit = int(self.zeros[-1])
        k = np.minimum(part, _U(limit + 1)).astype(np.int64) - 1  # the zero that ends the part before
        inside = (k >= 0) & (k < limit)
        k0 = np.where(inside, k, 0)
        word = np.searchsorted(self.zeros, k0, "right") - 1
        left = (k0 - self.zeros[word]).astype(np.int64)
        flipped = ~self.high[word]
        bit = np.zeros(len(k0), np.int64)
        for step in (32, 16, 8, 4, 2, 1):  # the left-th zero inside the word
            ones = np.bitwise_count((flipped >> bit.astype(_U)) & _U((1 << step) - 1)).astype(np.int64)
            on = ones <= left
            left -= np.where(on, ones, 0)
            bit += np.where(on, step, 0)
        return np.where(k < 0, 0, np.where(inside, word * 64 + bit - k0, self.n))

    def get(self, index: np.ndarray) -> np.ndarray:
        """The values at the indexes (which must exist)."""
        ones = np.arange(len(self.high), dtype=np.int64) * 64 - self.zeros[:-1]  # ones before each word
        word = np.searchsorted(ones, index, "right") - 1
        left = index - ones[word]
        bits = self.high[word]
        bit = np.zeros(len(index), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count((bits >> bit.astype(_U)) & _U((1 << step) - 1)).astype(np.int64)
            on = count <= left
            left = left - np.where(on, count, 0)
            bit += np.where(on, step, 0)
        up = (word * 64 + bit - index).astype(_U)
        return (up << _U(self.width)) | _get_bits(self.low, self.width, index)

    def all(self) -> np.ndarray:
        """The whole sequence."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        up = (ones - np.arange(self.n)).astype(_U)
        return (up << _U(self.width)) | _get_bits(self.low, self.width, np.arange(self.n))

    def locate(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(successor, whether it is x) for each x: the index of the first value that is at
        least x, n if there is none. Sorted queries are the fastest."""
        x = np.ascontiguousarray(x, _U)
        at, hit = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        for start in range(0, len(x) if self.n else 0, _PART):
            at[start : start + _PART], hit[start : start + _PART] = self._locate(x[start : start + _PART])
        return at, hit

    def _locate(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = x >> _U(self.width)
        lo = self._before(part)
        # the values of one high part are a run of ones, from bit lo + part on
        bit = np.minimum(lo + np.minimum(part, self.zeros[-1]).astype(np.int64), 64 * len(self.high) - 1)
        word, shift = bit >> 6, (bit & 63).astype(_U)
        after = self.high[np.minimum(word + 1, len(self.high) - 1)] * (word + 1 < len(self.high)).astype(_U)
        window = (self.high[word] >> shift) | np.where(shift > 0, after << ((_U(64) - shift) & _U(63)), _U(0))
        full = window == ~_U(0)
        hi = lo + np.where(full, 0, np.bitwise_count(window ^ (window + _U(1))).astype(np.int64) - 1)
        if full.any():
            hi[full] = np.where(part[full] + _U(1) == 0, self.n, self._before(part[full] + _U(1)))
        hi = np.clip(hi, lo, self.n)
        want, last = x & _U((1 << self.width) - 1), hi
        open_ = np.flatnonzero(lo < hi)
        while open_.size:
            mid = (lo[open_] + hi[open_]) // 2
            less = _get_bits(self.low, self.width, mid) < want[open_]
            if last is hi:
                hi, last = hi.copy(), hi
            hi[open_[~less]] = mid[~less]
            lo[open_[less]] = mid[less] + 1
            open_ = open_[lo[open_] < hi[open_]]
        hit = np.zeros(len(x), bool)
        inside = np.flatnonzero(lo < last)
        hit[inside] = _get_bits(self.low, self.width, lo[inside]) == want[inside]
        return lo, hit

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The index of the first value that is at least x; n if there is none."""
        return self.locate(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """The index of x, or -1."""
        at, hit = self.locate(x)
        return np.where(hit, at, -1)


#: Codes of a quantised probability: 0 for none, else steps of log10 from -LOWEST to 0.
CODES, LOWEST = 65535, 12.0


def quantise(p: np.ndarray) -> np.ndarray:
    code = np.rint((np.log10(np.maximum(p, 10.0**-LOWEST)) + LOWEST) / LOWEST * (CODES - 1)) + 1
    return np.where(p > 0, np.clip(code, 1, CODES), 0).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((code.astype(np.float64) - 1) / (CODES - 1) * LOWEST - LOWEST), 0.0)


@dataclass
class Trie:
    """Level one: contexts v. Level two: the words w that follow each of them, with the
    quantised smoothed probability of w after v. Level three: the words u before each pair v w,
    with that of w after u v. Words are hashes of some bits. A level's entries lie by their
    parents, which point to them by a monotone sequence; adding parent << bits makes the level
    monotone, and the successor of parent << bits | word is looked up in it."""

    bits: int
    contexts: EliasFano
    pointers2: EliasFano
    words: EliasFano
    codes2: np.ndarray
    pointers3: EliasFano
    before: EliasFano
    codes3: np.ndarray

    @classmethod
    def of(cls, bits: int, pairs: np.ndarray, codes2: np.ndarray, parent: np.ndarray, before: np.ndarray, codes3: np.ndarray) -> Trie:
        """pairs: sorted v << bits | w; parent, before: the place in pairs and the hash of u of
        each triple, sorted by both."""
        shift, mask = _U(bits), _U((1 << bits) - 1)
        contexts, first = np.unique(pairs >> shift, return_inverse=True)
        ends = lambda places, n: np.concatenate([[0], np.cumsum(np.bincount(places, minlength=n))]).astype(_U)
        level = lambda places, low: (places.astype(_U) << shift) | low
        return cls(
            bits, EliasFano.of(contexts), EliasFano.of(ends(first, len(contexts))), EliasFano.of(level(first, pairs & mask)), codes2.astype(np.uint16),
            EliasFano.of(ends(parent, len(pairs))), EliasFano.of(level(parent, before.astype(_U))), codes3.astype(np.uint16))

    def _child(self, parents: np.ndarray, low: np.ndarray, pointers: EliasFano, level: EliasFano) -> np.ndarray:
        """The place of each parent's child with the given hash; -1 if there is none."""
        if not level.n:
            return np.full(len(parents), -1)
        known = np.maximum(parents, 0)
        at, hit = level.locate((known.astype(_U) << _U(self.bits)) | low)
        ends = pointers.all().astype(np.int64)
        return np.where(hit & (parents >= 0) & (at >= ends[known]) & (at < ends[known + 1]), at, -1)

    def find_pairs(self, pairs: np.ndarray) -> np.ndarray:
        """The place of v << bits | w in level two, or -1."""
        return self._child(self.contexts.find(pairs >> _U(self.bits)), pairs & _U((1 << self.bits) - 1), self.pointers2, self.words)

    def find(self, places: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Codes of the triples of pairs (places in level two) with the words before them; 0 for unknown ones."""
        at = self._child(places, before.astype(_U), self.pointers3, self.before)
        return np.where(at >= 0, self.codes3[np.maximum(at, 0)] if len(self.codes3) else 0, 0).astype(np.uint16)

    def pack(self) -> bytes:
        parts = [s for e in (self.contexts, self.pointers2, self.words, self.pointers3, self.before) for s in e.sections()]
        parts += [np.array([self.bits], _U), self.codes2, self.codes3]
        raw = [np.ascontiguousarray(p).tobytes() for p in parts]
        sizes = np.array([len(raw), *map(len, raw)], _U).tobytes()
        return sizes + b"".join(r + b"\0" * (-len(r) % 8) for r in raw)

    @classmethod
    def unpack(cls, buffer) -> Trie:
        n = int(np.frombuffer(buffer, _U, 1)[0])
        sizes = np.frombuffer(buffer, _U, n, 8).astype(int).tolist()
        at, parts = 8 + 8 * n, []
        for i, size in enumerate(sizes):
            kind = np.uint16 if i >= n - 2 else _U
            parts.append(np.frombuffer(buffer, kind, size // np.dtype(kind).itemsize, at))
            at += size + -size % 8
        contexts, pointers2, words, pointers3, before = (EliasFano.mapped(*parts[i : i + 3]) for i in range(0, 15, 3))
        return cls(int(parts[15][0]), contexts, pointers2, words, parts[16], pointers3, before, parts[17])

    @classmethod
    def mapped(cls, packed: bytes) -> Trie:
        """The trie in a file that is mapped and has no name, so it goes with the process. It
        lies in the task's own temporary folder, as no other task reads it."""
        with tempfile.TemporaryFile() as f:
            f.write(packed)
            f.flush()
            return cls.unpack(mmap.mmap(f.fileno(), len(packed), access=mmap.ACCESS_READ))
