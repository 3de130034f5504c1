"""A two-level n-gram trie in Elias-Fano coded, memory-mapped levels.

Level one has a monotone pointer for each context; level two has each context's successors
in order, kept monotone over all contexts by adding the context's base. Probabilities and
back-off weights are quantised to 16 bits. A query finds the bucket of its base and successor by
the high bits and searches the low bits there.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Iterator

import numpy as np

#: Log10 probabilities from -FLOOR to 0 in 65,535 even steps; rounded down, so the sum never exceeds one.
FLOOR = 12.0
_STEPS = 65535


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.ceil(np.clip(-log10, 0.0, FLOOR) * (_STEPS / FLOOR)).astype(np.uint16)


def restore(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * (-FLOOR / _STEPS)


def _select(bits: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The place of the ``rest``-th set bit, from 0, of each word."""
    place = np.zeros(len(rest), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        part = bits & np.uint64((1 << half) - 1)
        lower = np.bitwise_count(part).astype(np.int64)
        up = rest >= lower
        rest = rest - np.where(up, lower, 0)
        bits = np.where(up, bits >> np.uint64(half), part)
        place += np.where(up, half, 0)
    return place


class EliasFano:
    """A non-decreasing sequence below ``universe``: low bits packed, high bits in unary with a rank directory."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray | None = None):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]) if before is None else before

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * low_bits + 63) // 64 + 1, np.uint64)
        if low_bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            part = values & np.uint64((1 << low_bits) - 1)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = np.flatnonzero(shift + np.uint64(low_bits) > 64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) >> 6) + 1 if n else 1, np.uint64)
        np.bitwise_or.at(high, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
        return cls(n, low_bits, low, high)

    def at(self, index: np.ndarray) -> np.ndarray:
        """Values at the given indices."""
        word = np.searchsorted(self.before, index, "right") - 1
        place = _select(self.high[word], index - self.before[word])
        return ((word * 64 + place - index) << self.low_bits) | self._low(index)

    def _low(self, index: np.ndarray) -> np.ndarray:
        """Low bits of the values at the given indices."""
        if not self.low_bits:
            return np.zeros(len(index), np.int64)
        bit = index.astype(np.uint64) * np.uint64(self.low_bits)
        at, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        spill = np.where(shift > 0, self.low[at + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (((self.low[at] >> shift) | spill) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have high bits below the given ones: the ones before the zero that ends the bucket before."""
        out = np.zeros(len(high), np.int64)
        rows = np.flatnonzero(high > 0)
        zero = high[rows] - 1
        before = np.arange(len(self.before)) * 64 - self.before
        past = zero >= before[-1]
        out[rows[past]] = self.n
        rows, zero = rows[~past], zero[~past]
        word = np.searchsorted(before, zero, "right") - 1
        out[rows] = word * 64 + _select(~self.high[word], zero - before[word]) - zero
        return out

    def index(self, values: np.ndarray) -> np.ndarray:
        """Where each value lies, -1 where it is missing: its bucket by the high bits, then a search of the low bits there."""
        wanted = values >> self.low_bits
        low, stop = self._below(wanted), self._below(wanted + 1)
        high, target = stop.copy(), values & ((1 << self.low_bits) - 1)
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            less = self._low(middle) < target[live]
            low[live[less]] = middle[less] + 1
            high[live[~less]] = middle[~less]
            live = live[low[live] < high[live]]
        out = np.full(len(values), -1, np.int64)
        inside = np.flatnonzero(low < stop)
        inside = inside[self._low(low[inside]) == target[inside]]
        out[inside] = low[inside]
        return out

    def dump(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], np.int64)
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.before.tobytes()

    @classmethod
    def load(cls, buffer: memoryview) -> tuple[EliasFano, memoryview]:
        n, low_bits, a, b = np.frombuffer(buffer[:32], np.int64).tolist()
        low = np.frombuffer(buffer[32 : 32 + 8 * a], np.uint64)
        high = np.frombuffer(buffer[32 + 8 * a : 32 + 8 * (a + b)], np.uint64)
        stop = 32 + 8 * (a + 2 * b + 1)
        before = np.frombuffer(buffer[32 + 8 * (a + b) : stop], np.int64)
        return cls(n, low_bits, low, high, before), buffer[stop:]


def build_shard(contexts: np.ndarray, words: np.ndarray, log10: np.ndarray, first: int, count: int, vocabulary: int) -> bytes:
    """Levels for the contexts first .. first + count - 1, from (context, word) in order."""
    ends = np.searchsorted(contexts, np.arange(first, first + count + 1))
    pointers = EliasFano.of(ends, len(words) + 1)
    successors = EliasFano.of((contexts - first) * vocabulary + words, count * vocabulary)
    codes = quantise(log10)
    head = np.array([first, count, len(codes), (-len(codes)) % 4], np.int64)
    return head.tobytes() + pointers.dump() + successors.dump() + codes.tobytes() + bytes(2 * int(head[3]))


def write_file(path: str, data: bytes) -> None:
    """Write whole or not at all, so a task that is run again does no harm."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(data)
    os.replace(part, path)


def map_file(path: str) -> memoryview:
    with open(path, "rb") as file:
        return memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))


class Trie:
    """Shards of the trie over one anonymous memory-mapped file, or over files (``mapped``)."""

    def __init__(self, shards: list[bytes], vocabulary: int):
        self.vocabulary = vocabulary
        self.parts = []
        total = sum(map(len, shards))
        if total:
            handle = os.memfd_create("ngram-trie")
            os.truncate(handle, total)
            self.map = mmap.mmap(handle, total)
            os.close(handle)
            view, at = memoryview(self.map), 0
            for shard in shards:
                view[at : at + len(shard)] = shard
                self.parts.append(self._open(view[at : at + len(shard)]))
                at += len(shard)
        self._order()

    def _order(self) -> None:
        self.parts.sort(key=lambda p: p[0])
        self.firsts = np.array([p[0] for p in self.parts], np.int64)

    @classmethod
    def mapped(cls, paths: list[str], vocabulary: int) -> Trie:
        """The trie over files of a shard and its back-off weights each, which are mapped, not read."""
        trie = cls([], vocabulary)
        trie.parts = [cls._open(map_file(path)) for path in paths]
        trie._order()
        return trie

    @staticmethod
    def _open(view: memoryview) -> tuple:
        first, count, n, pad = np.frombuffer(view[:32], np.int64).tolist()
        pointers, rest = EliasFano.load(view[32:])
        successors, rest = EliasFano.load(rest)
        back = rest[2 * (n + pad) :]
        return first, count, pointers, successors, np.frombuffer(rest[: 2 * n], np.uint16), np.frombuffer(back[: 2 * count], np.uint16)

    def _shards(self, contexts: np.ndarray) -> Iterator[tuple[tuple, np.ndarray]]:
        """The shards that hold some of the contexts, each with the rows of those."""
        by = np.argsort(contexts, kind="stable")
        ordered = contexts[by]
        cuts = np.append(np.searchsorted(ordered, self.firsts), len(by))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            stop = cuts[k] + np.searchsorted(ordered[cuts[k] : cuts[k + 1]], self.firsts[k] + self.parts[k][1])
            yield self.parts[k], by[cuts[k] : stop]

    def back_offs(self, contexts: np.ndarray) -> np.ndarray:
        """Log10 back-off weight of each context; 0 for those of no shard."""
        out = np.zeros(len(contexts))
        for part, rows in self._shards(contexts):
            out[rows] = restore(part[5][contexts[rows] - part[0]])
        return out

    def find(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Log10 probability of each (context, word); nan for pairs that the trie lacks."""
        out = np.full(len(contexts), np.nan)
        for (first, _, _, successors, codes, _), rows in self._shards(contexts):
            at = successors.index((contexts[rows] - first) * self.vocabulary + words[rows])
            hit = np.flatnonzero(at >= 0)
            out[rows[hit]] = restore(codes[at[hit]])
        return out
