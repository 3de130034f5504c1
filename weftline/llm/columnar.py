"""Columnar text helpers for Arrow batches: slicing by bytes, word splitting, ragged gathers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words: space and \t \n \v \f \r.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

def keep_arenas() -> None:
    """Let the C allocator reuse freed blocks instead of mapping fresh pages for every large array."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD


SLICE_BYTES = 4 << 20


def plain_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A contiguous string array with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    return column


def bytes_and_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text bytes as uint8, and the row offsets into them, from 0."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: each holds at most ``limit`` text bytes, or a single row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])


def strings_from(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string array over ``data`` cut at ``offsets``."""
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def split_words(texts: pa.Array, fold: np.ndarray | None = None, spaces: np.ndarray = SPACES) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts in order, and each text's offsets into them.

    ``fold``: optional table of 256 bytes that is applied to each byte (ASCII case folding).
    ``spaces``: table of the 256 bytes, true for those that separate words.
    """
    data, offsets = bytes_and_offsets(texts)
    if len(data) == 0:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    inside = ~spaces[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = inside[first]
    begins = np.flatnonzero(start)
    kept = data[inside]
    if fold is not None:
        kept = fold[kept]
    before = np.cumsum(inside, dtype=np.int32)
    cuts = np.append(before[begins] - 1, len(kept)).astype(np.int32)
    return strings_from(kept, cuts), np.searchsorted(begins, offsets)


_RANDOM = np.random.default_rng(20240229)
_BYTES = _RANDOM.integers(1, 2**63, 256, np.uint64)
_PLACES = _RANDOM.integers(1, 2**63, 4096, np.uint64) | np.uint64(1)


def encode_words(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words and the distinct words they point to."""
    if len(words) == 0:
        return np.zeros(0, np.int64), words
    data, cuts = bytes_and_offsets(words)
    lengths = np.diff(cuts)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(cuts[:-1], lengths)
    if int(lengths.max()) > len(_PLACES):
        coded = words.dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _PLACES[place])])
    codes, _ = pd.factorize((sums[cuts[1:]] - sums[cuts[:-1]]).view(np.int64))
    first = np.empty(int(codes.max()) + 1, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    # Words that share a sum must be the same bytes; else the exact dictionary takes over.
    twin = first[codes]
    same = (lengths == lengths[twin]).all() and (data == data[place + np.repeat(cuts[twin], lengths)]).all()
    if not same:
        coded = words.dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary
    return codes, words.take(pa.array(first))


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``range(start, start + length)`` for each pair."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths) + np.arange(total)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (fixed multipliers of a public finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same on every machine."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    data, offsets = bytes_and_offsets(values)
    view, cuts = memoryview(np.ascontiguousarray(data)), offsets.tolist()
    return np.fromiter((digest(view[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)), np.uint64, len(values))


def running_starts(keys: np.ndarray) -> np.ndarray:
    """True where a sorted key differs from the one before."""
    out = np.ones(len(keys), bool)
    if len(keys) > 1:
        out[1:] = keys[1:] != keys[:-1]
    return out
