"""Benchmark decontamination by latent semantic retrieval.

Features are the words of the benchmark's passages, weighted by inverse document frequencies
over all documents. A randomised SVD of TF-IDF passages (the benchmark's, and those of all
documents) gives the latent space; the features of all passages are written once, the products run
where they lie, only matrices of features by rank are summed. Windows of every
document, at three widths and a step of eight words, are candidates for the benchmark passages
whose cosine reaches ``min_cosine``. A candidate is a leak when the longest common
subsequence covers the benchmark passage by ``strong_cover``, or by ``weak_cover`` with the
passage's answer, its last words, found in one piece.

Words are runs of letters and digits, A-Z lower-cased. Benchmark texts are cut into passages of
at most ``passage_words`` words. The benchmark is the stated query set: workers have it in shards of at
most ``shard_bytes`` of text (and one item), each with a space of its own; more shards are more passes.

Defined cases: null texts, on either side, hold no words and match nothing; items below
``min_words`` words leak where all their words stand in a row, those below ``exact_words`` only
into a text of nothing else; repeated rows are judged one by one; an empty table, or an empty
benchmark, gives no leaks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.columnar import encode_words, hash_strings, keep_arenas, plain_strings, ragged_index, running_starts, slices, split_words
from weftline.scratch import materialize, sweep


@dataclass(frozen=True)
class LeakLimits:
    rank: int = 192
    oversampling: int = 16
    min_cosine: float = 0.6
    strong_cover: float = 0.7
    weak_cover: float = 0.5
    answer_words: int = 5
    min_words: int = 8
    exact_words: int = 4
    shard_bytes: int = 4 << 20
    passage_words: int = 64
    #: Features whose products are dense; a matter of speed alone.
    dense_features: int = 256
    #: Blocks of words, and the widths of the windows in blocks.
    block: int = 8
    widths: tuple[int, ...] = (3, 6, 12)


_SEPARATORS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


class Queries:
    """Benchmark passages over their own vocabulary."""

    def __init__(self, ids: list, texts: list, limits: LeakLimits):
        words, bounds = split_words(plain_strings(pa.array(texts, pa.string())), _FOLD, _SEPARATORS)
        codes, distinct = encode_words(words)
        self.hashes, first, place = np.unique(hash_strings(distinct), return_index=True, return_inverse=True)
        #: The words by feature.
        self.vocabulary = distinct.take(pa.array(first))
        codes = place[codes] if len(codes) else codes
        self.items, self.words = [], []
        #: Items too short for a window, by their words.
        self.short: dict[bytes, list] = {}
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if 0 < b - a < limits.min_words:
                self.short.setdefault(codes[a:b].tobytes(), []).append(ids[i])
                continue
            parts = max(1, -(-(b - a) // limits.passage_words))
            for part in np.array_split(codes[a:b], parts):
                if len(part) >= limits.min_words:
                    self.items.append(ids[i])
                    self.words.append(part)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Feature of each word; -1 for words of no benchmark passage."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def features(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Feature of every word of the texts, and each text's offsets."""
        words, bounds = split_words(plain_strings(column), _FOLD, _SEPARATORS)
        if len(self.vocabulary) <= len(words):
            return pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy().astype(np.int64), bounds
        # A larger vocabulary isn't hashed anew for each slice.
        codes, distinct = encode_words(words)
        found = self.find(hash_strings(distinct))
        return (found[codes] if len(codes) else np.zeros(0, np.int64)), bounds


def _add_runs(out: np.ndarray, runs: np.ndarray, index: np.ndarray, value: np.ndarray, matrix: np.ndarray) -> None:
    """Adds the sum of ``value * matrix[index]`` over each run of equal neighbours to that row of ``out``; no two runs are alike.

    Runs of the same length are multiplied at once, some 2,048 rows of ``matrix`` at a time.
    """
    firsts = np.flatnonzero(running_starts(runs))
    lengths = np.diff(np.append(firsts, len(runs)))
    by = np.argsort(lengths, kind="stable")
    cuts = np.append(np.flatnonzero(running_starts(lengths[by])), len(by)).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        length = int(lengths[by[a]])
        step = max(1, 2048 // length)
        for i in range(a, b, step):
            begin = firsts[by[i : min(i + step, b)]]
            at = begin[:, None] + np.arange(length)
            out[runs[begin]] += np.matmul(value[at][:, None, :], matrix[index[at]])[:, 0]


def _gram_product(columns: np.ndarray, times: np.ndarray, sizes: np.ndarray, idf: np.ndarray, often: np.ndarray, basis: np.ndarray, out: np.ndarray) -> None:
    """Adds A^T (A basis) to ``out`` for the unit TF-IDF rows of passages: their features one after the other, the times of each, and the features a passage.

    ``often``: features whose part of A is multiplied as a dense matrix; all others are gathered.
    """
    slot = np.full(len(idf), -1, np.int64)
    slot[often] = np.arange(len(often))
    dense = basis[often]
    dense_out = np.zeros(dense.shape)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    for i in range(0, len(sizes), 2048):
        low, high = ends[i], ends[min(i + 2048, len(sizes))]
        count = len(sizes[i : i + 2048])
        row = np.repeat(np.arange(count), sizes[i : i + 2048])
        value = times[low:high] * idf[columns[low:high]]
        norm = np.sqrt(np.bincount(row, value**2, count))
        value = (value / np.maximum(norm[row], 1e-12)).astype(np.float32)
        place = slot[columns[low:high]]
        common = np.flatnonzero(place >= 0)
        block = np.zeros((count, len(often)), np.float32)
        block[row[common], place[common]] = value[common]
        image = block @ dense
        rest = np.flatnonzero(place < 0)
        row, column, value = row[rest], columns[low:high][rest], value[rest]
        if len(rest):
            _add_runs(image, row, column, value, basis)
            by = np.argsort(column, kind="stable")
            _add_runs(out, column[by], row[by], value[by], image)
        dense_out += block.T @ image
    out[often] += dense_out


def _feature_counts(features: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of passages that begin at ``starts``: the distinct features one after the other, the times of each, and their number a passage."""
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(features))))
    inside = features >= 0
    keys, times = np.unique(row[inside] * n + features[inside], return_counts=True)
    sizes = np.bincount(keys // n, minlength=len(starts)) if len(keys) else np.zeros(len(starts), np.int64)
    return (keys % n).astype(np.int32), times.astype(np.int32), sizes[sizes > 0].astype(np.int32)


_PASSAGES = "docs long, held binary, times_held binary, features binary, times binary, sizes binary"


def counted_passages(docs: DataFrame, queries: Queries, limits: LeakLimits, text_col: str, tag: str) -> DataFrame:
    """A written table, one row a slice of ``docs``: its documents, those that hold each feature, and the features of all its passages."""
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_arenas()
        n = len(shared.value.hashes)
        for batch in slices(batches, "text"):
            features, bounds = shared.value.features(batch.column(0))
            passages = -(-np.diff(bounds) // limits.passage_words)
            starts = np.repeat(bounds[:-1], passages) + ragged_index(np.zeros(len(passages)), passages) * limits.passage_words
            columns, times, sizes = _feature_counts(features, starts, n)
            inside = features >= 0
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            held, times_held = np.unique(np.unique(row[inside] * n + features[inside]) % n, return_counts=True)
            parts = (held.astype(np.int32), times_held.astype(np.int32), columns, times, sizes)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["docs", "held", "times_held", "features", "times", "sizes"])

    return materialize(docs.select(F.col(text_col).alias("text")).mapInArrow(count, _PASSAGES), "passages", tag)


def _ints(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.int32)


def document_frequencies(passages: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, over all documents, and their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros(size, np.int64), 0
        for batch in batches:
            total += int(np.sum(batch.column(0).to_numpy()))
            for features, times in zip(batch.column(1), batch.column(2), strict=True):
                held[_ints(features)] += _ints(times)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(held[used], total))], names=["feature", "n"])

    counted = passages.select("docs", "held", "times_held").mapInArrow(count, "feature long, n long")
    summed = counted.groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1, np.int64)
    out[summed["feature"].to_numpy()] = summed["n"].to_numpy()
    return out[:-1], int(out[-1])


def latent_space(passages: DataFrame, queries: Queries, idf: np.ndarray, limits: LeakLimits) -> np.ndarray:
    """Orthonormal columns [features, rank]: the leading right singular vectors of the TF-IDF passages, the benchmark's and those of all documents."""
    size = len(idf)
    rank = min(limits.rank, size)
    width = min(size, rank + limits.oversampling)
    spark = passages.sparkSession
    # The features of most documents have the least weight.
    often = np.argsort(idf, kind="stable")[: limits.dense_features]
    own = _feature_counts(np.concatenate(queries.words), np.cumsum([0, *map(len, queries.words)])[:-1], size)

    def product(basis: np.ndarray) -> np.ndarray:
        basis = basis.astype(np.float32)
        shared = spark.sparkContext.broadcast((idf, often, basis))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_arenas()
            weights, dense, matrix = shared.value
            total = np.zeros(matrix.shape)
            for batch in batches:
                for features, times, sizes in zip(*batch.columns, strict=True):
                    _gram_product(_ints(features), _ints(times), _ints(sizes), weights, dense, matrix, total)
            for i in range(0, size, 256):
                if total[i : i + 256].any():
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([total[i : i + 256].astype(np.float32).tobytes()], pa.binary())], names=["block", "sums"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in table["sums"])
            return pa.table({"block": table["block"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

        found = passages.select("features", "times", "sizes").mapInArrow(multiply, "block long, sums binary")
        sums = found.groupBy("block").applyInArrow(add, "block long, sums binary").toArrow()
        shared.destroy()
        out = np.zeros(basis.shape)
        _gram_product(*own, idf, often, basis, out)
        for block, raw in zip(sums["block"].to_pylist(), sums["sums"].to_pylist(), strict=True):
            rows = np.frombuffer(raw, np.float64).reshape(-1, basis.shape[1])
            out[block : block + len(rows)] += rows
        return out

    start = np.random.default_rng(31337).standard_normal((size, width))
    basis, _ = np.linalg.qr(product(start))
    image = product(basis)
    values, vectors = np.linalg.eigh(basis.T @ image)
    return basis @ vectors[:, np.argsort(-values)[:rank]]


class Detector:
    """Finds leaks in Arrow batches."""

    def __init__(self, queries: Queries, idf: np.ndarray, outside: float, space: np.ndarray, limits: LeakLimits):
        self.queries, self.idf, self.outside, self.limits = queries, idf, outside, limits
        self.rows = (idf[:, None] * space).astype(np.float32)
        self.seen = np.zeros(len(idf) + 1, bool)  # the last slot is that of words outside, -1
        latent = np.stack([self.rows[w].sum(0) for w in queries.words]) if queries.words else np.zeros((0, space.shape[1]), np.float32)
        # Windows of two blocks only for benchmarks with passages that would be lost in wider ones.
        short = min(map(len, queries.words), default=16) < 16
        self.widths = (2, *limits.widths) if short else limits.widths
        self.short_sizes = sorted({len(x) // 8 for x in queries.short})
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def leaks(self, column: pa.Array) -> list[tuple[int, object, float, float, bool]]:
        """(row, item, cosine, cover, answer found): the best window of each leaked item, by row and item."""
        features, bounds = self.queries.features(column)
        out = self._short(features, bounds)
        if len(features) and len(self.latent):
            out |= self._windows(features, bounds)
        return [(row, item, c, l, a) for (row, item), (l, a, c) in out.items()]

    def _short(self, features: np.ndarray, bounds: np.ndarray) -> dict[tuple, tuple]:
        """Items below ``min_words`` words, word for word."""
        out: dict[tuple, tuple] = {}
        row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for size in self.short_sizes:
            if len(features) < size:
                continue
            runs = np.lib.stride_tricks.sliding_window_view(features, size)
            at = np.flatnonzero((row_of[: len(runs)] == row_of[size - 1 :]) & (runs >= 0).all(1))
            if size < self.limits.exact_words:
                at = at[np.diff(bounds)[row_of[at]] == size]
            for i in at.tolist():
                for item in self.queries.short.get(runs[i].tobytes(), ()):
                    out[int(row_of[i]), item] = (1.0, True, 1.0)
        return out

    def _windows(self, features: np.ndarray, bounds: np.ndarray) -> dict[tuple, tuple]:
        """Items whose passages a window of a text is close to and shares their words with in order."""
        limits = self.limits
        sizes = np.diff(bounds)
        blocks = -(-sizes // limits.block)
        first_block = np.concatenate([[0], np.cumsum(blocks)])
        cuts = np.append(np.repeat(bounds[:-1], blocks) + ragged_index(np.zeros(len(blocks)), blocks) * limits.block, len(features))
        inside = features >= 0
        energy = np.where(inside, self.idf[features] ** 2, self.outside**2)
        block_all = np.concatenate([[0.0], np.cumsum(np.add.reduceat(energy, cuts[:-1]))])
        block_in = np.concatenate([[0.0], np.cumsum(np.add.reduceat(np.where(inside, energy, 0.0), cuts[:-1]))])
        row_of = np.repeat(np.arange(len(sizes)), blocks)
        begin = np.arange(len(row_of))
        windows = []
        wanted = np.zeros(len(begin) + 1, np.int64)
        for width in self.widths:
            end = np.minimum(begin + width, first_block[row_of + 1])
            # A window whose known words hold too little weight can't reach the cosine.
            able = block_in[end] - block_in[begin] >= limits.min_cosine**2 * (block_all[end] - block_all[begin])
            able &= (end - begin == width) | (begin == first_block[row_of])
            at = np.flatnonzero(able)
            windows.append((at, end[at]))
            np.add.at(wanted, at, 1)
            np.add.at(wanted, end[at], -1)
        need = np.cumsum(wanted[:-1]) > 0
        token_block = np.repeat(begin, np.diff(cuts))
        chosen = np.flatnonzero(inside & need[token_block])
        if not len(chosen):
            return {}
        # Prefix sums over the needed blocks alone; the blocks of a needed window are neighbours there too.
        packed = np.concatenate([[0], np.cumsum(need)])
        sums = np.zeros((packed[-1] + 1, self.rows.shape[1]), np.float32)
        own = packed[token_block[chosen]]
        _add_runs(sums[1:], own, features[chosen], np.ones(len(chosen), np.float32), self.rows)
        total = np.cumsum(sums, axis=0, dtype=np.float64)
        best: dict[tuple[int, int], list] = {}
        for at, end in windows:
            for i in range(0, len(at), 8192):
                a, b = at[i : i + 8192], end[i : i + 8192]
                vectors = (total[packed[b]] - total[packed[a]]).astype(np.float32)
                norm = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
                for q in range(0, len(self.latent), 4096):
                    cosine = vectors @ self.latent[q : q + 4096].T / norm[:, None]
                    for w, item in zip(*np.nonzero(cosine >= limits.min_cosine), strict=True):
                        best.setdefault((int(row_of[a[w]]), q + int(item)), []).append((float(cosine[w, item]), int(a[w]), int(b[w])))
        out: dict[tuple, tuple] = {}
        for (row, passage), found in sorted(best.items()):
            hit = self._check(row, passage, found, features, cuts, bounds)
            key = (row, self.queries.items[passage])
            if hit and (key not in out or hit > out[key]):
                out[key] = hit
        return out

    def _check(self, row: int, passage: int, found: list, features: np.ndarray, cuts: np.ndarray, bounds: np.ndarray) -> tuple | None:
        limits, words = self.limits, self.queries.words[passage]
        answer = words[-limits.answer_words :].tobytes()
        best = None
        for cosine, a, b in sorted(found, reverse=True):
            low = max(int(bounds[row]), int(cuts[a]) - limits.block)
            high = min(int(bounds[row + 1]), int(cuts[b]) + limits.block)
            window = features[low:high]
            # No subsequence is longer than the words that both hold.
            self.seen[window] = True
            shared = self.seen[words].sum()
            self.seen[window] = False
            if shared < limits.weak_cover * len(words):
                continue
            cover = common_subsequence(words, window[window >= 0]) / len(words)
            at = window.tobytes().find(answer)
            while at > 0 and at % 8:
                at = window.tobytes().find(answer, at + 1)
            if cover >= limits.strong_cover or (cover >= limits.weak_cover and at >= 0):
                best = max(best or (0.0, False, 0.0), (cover, at >= 0, cosine))
                if cover == 1.0:
                    break
        return best


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        match = row & masks.get(x, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def fit(docs: DataFrame, benchmark: DataFrame, limits: LeakLimits, text_col: str, item_col: str, item_text_col: str) -> Iterator[Detector]:
    """Detectors for the shards of the benchmark, with weights over all ``docs``."""
    stated = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    size = stated.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = -(-size // limits.shard_bytes)
    for shard in range(shards):
        own = stated.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard).toArrow()
        queries = Queries(own["item"].to_pylist(), own["text"].to_pylist(), limits)
        if not queries.words:
            yield Detector(queries, np.ones(len(queries.hashes)), 1.0, np.zeros((len(queries.hashes), 1)), limits)
            continue
        tag = f"leaks {uuid.uuid4().hex}"
        passages = counted_passages(docs, queries, limits, text_col, tag)
        held, n_docs = document_frequencies(passages, len(queries.hashes))
        idf = np.log((n_docs + 1.0) / (held + 1.0)) + 0.05
        space = latent_space(passages, queries, idf, limits)
        sweep(docs.sparkSession, tag)
        yield Detector(queries, idf, float(idf.mean()), space, limits)


def _no_leaks(docs: DataFrame, id_type: str, item_type: str) -> DataFrame:
    return docs.sparkSession.createDataFrame([], f"doc_id {id_type}, item_id {item_type}, cosine double, cover double, answer boolean")


def find_leaks(docs: DataFrame, benchmark: DataFrame, limits: LeakLimits = LeakLimits(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, cover, answer of every leaked item, one row for each document and item."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type, item_type = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    out = None
    for fitted in fit(docs, benchmark, limits, text_col, item_col, item_text_col):
        detector = docs.sparkSession.sparkContext.broadcast(fitted)
        found = rows.mapInArrow(_finder(detector), f"doc_id {id_type}, item_id {item_type}, cosine double, cover double, answer boolean")
        out = found if out is None else out.unionByName(found)
    return _no_leaks(docs, id_type, item_type) if out is None else out


def _finder(detector):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_arenas()
        for batch in slices(batches, "text", 1 << 20):
            leaks = detector.value.leaks(batch.column(1))
            if leaks:
                row, item, cosine, cover, answer = zip(*leaks, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item), pa.array(cosine), pa.array(cover), pa.array(answer)], names=["doc_id", "item_id", "cosine", "cover", "answer"])

    return find


def drop_leaks(docs: DataFrame, benchmark: DataFrame, limits: LeakLimits = LeakLimits(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, in which no benchmark item leaks."""
    place = docs.columns.index(text_col)
    out = docs
    for fitted in fit(docs, benchmark, limits, text_col, item_col, item_text_col):
        out = out.mapInArrow(_cleaner(docs.sparkSession.sparkContext.broadcast(fitted), place, text_col), docs.schema)
    return out


def _cleaner(detector, place: int, text_col: str):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_arenas()
        for batch in slices(batches, text_col, 1 << 20):
            keep = np.ones(batch.num_rows, bool)
            keep[[x[0] for x in detector.value.leaks(batch.column(place))]] = False
            yield batch.filter(pa.array(keep))

    return clean
