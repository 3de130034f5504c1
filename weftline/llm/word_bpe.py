"""Token ids of the public ``word_bpe_49k.json`` vocabulary for whole Arrow batches.

White space never reaches a token of this vocabulary, so a text's ids are the ids of its
white-space separated chunks one after another. Chunks of plain letters followed by plain
punctuation are merged for all distinct chunks at once in numpy, by the ranks of the file;
every other chunk is encoded by the tokenizers library itself.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from weftline.llm.columnar import bytes_and_offsets, encode_words, ragged_index, split_words

_NONE = np.int32(2**31 - 1)
_LOADED: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The vocabulary of ``path``, loaded once in each worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class _PairTable:
    """Open-addressed map from a pair of ids to its merge rank."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, _NONE, np.int32)
        for key, rank, slot in zip(keys.tolist(), ranks.tolist(), self._slot(keys).tolist(), strict=True):
            while self.keys[slot] != -1:
                slot = (slot + 1) % size
            self.keys[slot], self.ranks[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        shape, keys = keys.shape, keys.ravel()
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], _NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out.reshape(shape)


class WordBpe:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = json.loads(self.library.to_str())["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        names = _byte_names()
        self.inner = np.array([vocab.get(x, -1) for x in names], np.int32)
        self.last = np.array([vocab.get(x + end, -1) for x in names], np.int32)
        self.base = len(vocab)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.table = _PairTable(left * self.base + right, np.arange(len(pairs)))
        letters = np.zeros(256, bool)
        letters[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
        self.letter = letters
        marks = np.zeros(256, bool)
        marks[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = True
        self.mark = marks

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and each text's offsets into them."""
        words, bounds = split_words(texts)
        codes, distinct = encode_words(words)
        ids, cuts = self.encode_chunks(distinct)
        lengths = np.diff(cuts)[codes] if len(codes) else np.zeros(0, np.int64)
        flat = ids[ragged_index(cuts[:-1][codes], lengths)] if len(codes) else np.zeros(0, np.uint32)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return flat, ends[bounds]

    def encode_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of distinct chunks without white space."""
        n = len(chunks)
        data, cuts = bytes_and_offsets(chunks)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        # Letters: a-z, A-Z and the two-byte letters U+00C0..U+00FF; all fold to lower case bytewise.
        low = data.copy()
        upper = (data >= 0x41) & (data <= 0x5A)
        low[upper] += 0x20
        kind = np.where(self.letter[data], 0, np.where(self.mark[data], 1, 2)).astype(np.int8)
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[lead + 1 < len(data)]
        tail = data[lead + 1]
        good = (tail >= 0x80) & (tail != 0x97) & (tail != 0xB7)
        kind[lead[good]] = kind[lead[good] + 1] = 0
        capital = lead[good & (tail <= 0x9E)] + 1
        low[capital] += 0x20
        # A simple chunk is letters, then marks: at most one change of kind, from 0 to 1.
        owner = np.repeat(np.arange(n), np.diff(cuts))
        simple = np.ones(n, bool)
        simple[owner[kind == 2]] = False
        falls = np.flatnonzero((kind[1:] < kind[:-1]) & (owner[1:] == owner[:-1]))
        simple[owner[falls]] = False
        simple &= np.diff(cuts) <= 64
        letters = np.bincount(owner[kind == 0], minlength=n)
        total = np.diff(cuts)
        # Two parts a chunk: part 2 i has the letters, part 2 i + 1 the marks.
        starts = np.stack([cuts[:-1], cuts[:-1] + letters], 1).ravel()
        sizes = np.stack([letters, total - letters], 1).ravel()
        sizes[np.repeat(~simple, 2)] = 0
        out_len = np.zeros(2 * n, np.int64)
        pieces: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == size)
            rows = low[starts[at][:, None] + np.arange(size)]
            grid, used = self._merge(rows)
            out_len[at] = used
            pieces.append((at, grid))
        other = np.flatnonzero(~simple)
        by_library: list[list[int]] = []
        if len(other):
            by_library = [e.ids for e in self.library.encode_batch_fast(chunks.take(pa.array(other)).to_pylist(), add_special_tokens=False)]
            out_len[2 * other] = [len(x) for x in by_library]
        offsets = np.concatenate([[0], np.cumsum(out_len)])
        ids = np.empty(offsets[-1], np.uint32)
        for at, grid in pieces:
            where = offsets[at][:, None] + np.arange(grid.shape[1])
            valid = np.arange(grid.shape[1]) < out_len[at][:, None]
            ids[where[valid]] = grid[valid]
        if by_library:
            ids[ragged_index(offsets[2 * other], out_len[2 * other])] = np.fromiter((i for x in by_library for i in x), np.uint32, int(out_len[2 * other].sum()))
        return ids, offsets[::2]

    def _merge(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte rows of one length to ids: always the leftmost pair of lowest rank, one a round, in all rows at once."""
        m, n = rows.shape
        grid = self.inner[rows]
        grid[:, -1] = self.last[rows[:, -1]]
        out, used = grid.copy(), np.full(m, n, np.int64)
        live, width = np.arange(m), n
        rank = self._rank(grid[:, :-1], grid[:, 1:]) if n > 1 else None
        while width > 1 and len(live):
            at = rank.argmin(1)
            row = np.arange(len(live))
            best = rank[row, at]
            go = best != _NONE
            if not go.all():
                stop = live[~go]
                out[stop, :width], used[stop] = grid[~go], width
                live, grid, rank, at, best = live[go], grid[go], rank[go], at[go], best[go]
                row = np.arange(len(live))
                if not len(live):
                    break
            grid[row, at] = self.made[best]
            place = np.arange(width)
            grid = grid[place != at[:, None] + 1].reshape(len(live), width - 1)
            rank = rank[place[:-1] != at[:, None]].reshape(len(live), width - 2)
            width -= 1
            if width > 1:
                has = np.flatnonzero(at > 0)
                rank[has, at[has] - 1] = self._rank(grid[has, at[has] - 1], grid[has, at[has]])
                has = np.flatnonzero(at < width - 1)
                rank[has, at[has]] = self._rank(grid[has, at[has]], grid[has, at[has] + 1])
        if len(live):
            out[live, :width], used[live] = grid, width
        return out, used

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.table.rank(left.astype(np.int64) * self.base + right)
