"""Language-model scores from an Elias-Fano bigram trie over the whole training corpus.

Tokens are white-space separated words, A-Z lower-cased, and one end a text. Every word of the
training texts has an id, its rank among the words' hashes, and the trie has every pair of them,
so both grow with the input. A pair's probability is interpolated by absolute discounting with the
smoothed unigram of the second. A word that no training text has counts 0 and gets the smoothing
alone. Where ``trie_words`` is set, all but the most frequent words share one class, in which a
word has its smoothed unigram share.

Words with their counts lie in files cut by hash, the trie's contexts in files cut by id, both
below the shared scratch folder; workers map them and read the pages that their texts ask for.

Defined cases: a null text is an empty one and has the end alone; without training texts N and V
are 0; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.columnar import encode_words, hash_strings, keep_arenas, plain_strings, running_starts, slices, split_words
from weftline.llm.elias_fano import Trie, build_shard, map_file, quantise, write_file
from weftline.scratch import local_folder, materialize

#: The end token; no word holds white space, so none has its name.
END_HASH = np.uint64(xxhash.xxh3_64_intdigest(b"\nend of text")).view(np.int64)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_MAPPED: dict[str, object] = {}
#: Words and pairs of training tokens in one file, as a mean.
FILE_WORDS, FILE_TOKENS = 1 << 19, 1 << 19
#: Bytes of text whose words and pairs are counted, and scored, at once.
COUNTED_BYTES, SCORED_BYTES = 2 << 20, 2 << 20


@dataclass(frozen=True)
class ScoreLimits:
    #: None: all words of the training texts.
    trie_words: int | None = None
    #: Without effect since all counts are mapped; kept for callers that set it.
    sent_counts: int = 131_072
    smoothing: float = 0.1
    discount: float = 0.75
    #: Files of words and of contexts at least.
    shards: int = 64

    @property
    def vocabulary(self) -> int:
        """Ids of a trie of ``trie_words``: 0 the class of other words, then end and words, last the start of a text."""
        return self.trie_words + 3


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words, hashes of the distinct ones, and each text's offsets."""
    words, bounds = split_words(plain_strings(column), _FOLD)
    codes, distinct = encode_words(words)
    return codes, hash_strings(distinct).view(np.int64), bounds


def _with_ends(ids: np.ndarray, bounds: np.ndarray, start_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and words of all pairs: each text's ids, led by the start and closed by the end (id 1)."""
    words = np.insert(ids, bounds[1:], 1)
    contexts = np.insert(ids, bounds[:-1], start_id)
    return contexts, words


def word_counts(train: DataFrame) -> DataFrame:
    """hash, n of every token of the rows (text), ends included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_arenas()
        # The files of a model before are not asked for any more.
        _MAPPED.clear()
        for batch in slices(batches, "text", COUNTED_BYTES):
            codes, hashes, _ = _tokens(batch.column(0))
            n = np.bincount(codes, minlength=len(hashes)) if len(codes) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(hashes, END_HASH)), pa.array(np.append(n, batch.num_rows).astype(np.int64))], names=["hash", "n"])

    return train.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """What workers need to open the files: their places, and the totals of the training texts."""

    words: list[tuple[int, int, str]]  # bucket, rank of its first word, path; by bucket
    bits: int
    size: int
    tokens: int
    kinds: int
    ends: int
    smoothing: float
    top: np.ndarray | None  # hashes of the trie's words in order, where they are limited
    top_ids: np.ndarray | None
    own: np.ndarray | None  # counts of the trie's ids then


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> (64 - bits)) + (1 << (bits - 1))


class Words:
    """Counts and trie ids of words, from the mapped files of ``write_words``."""

    def __init__(self, model: Model):
        self.model, self.parts = model, {}
        self.firsts = np.array([first for _, first, _ in model.words], np.int64)
        for bucket, first, path in model.words:
            view = map_file(path)
            n = len(view) // 16
            self.parts[bucket] = first, np.frombuffer(view[: 8 * n], np.int64), np.frombuffer(view[8 * n :], np.int64)

    @classmethod
    def of(cls, model: Model) -> Words:
        """One a process, as long as the same files are asked for."""
        name = model.words[0][2] if model.words else ""
        if _MAPPED.get("words", ("",))[0] != name or not name:
            _MAPPED["words"] = name, cls(model)
        return _MAPPED["words"][1]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (0: unseen) and trie ids (0: the class of others)."""
        model = self.model
        by = np.argsort(hashes)
        wanted = hashes[by]
        count, rank = np.zeros(len(hashes), np.int64), np.full(len(hashes), -2, np.int64)
        cuts = np.searchsorted(_bucket(wanted, model.bits), np.arange((1 << model.bits) + 1))
        for bucket, (first, known, counts) in self.parts.items():
            part = wanted[cuts[bucket] : cuts[bucket + 1]]
            at = np.minimum(np.searchsorted(known, part), len(known) - 1)
            hit = np.flatnonzero(known[at] == part)
            count[by[cuts[bucket] + hit]], rank[by[cuts[bucket] + hit]] = counts[at[hit]], first + at[hit]
        if model.top is None:
            return count, rank + 2
        at = np.minimum(np.searchsorted(model.top, hashes), max(len(model.top) - 1, 0))
        return count, np.where(model.top[at] == hashes, model.top_ids[at], 0) if len(model.top) else np.zeros(len(hashes), np.int64)

    def unigrams(self, ids: np.ndarray) -> np.ndarray:
        """Smoothed unigram of each trie id; the start is never a word."""
        model = self.model
        if model.own is not None:
            own = model.own[ids]
        else:
            own = np.where(ids == 1, model.ends, 0)
            by = np.argsort(ids, kind="stable")
            cuts = np.searchsorted(ids[by], np.append(self.firsts + 2, max(model.size - 1, 2)))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                first, _, counts = self.parts[model.words[k][0]]
                rows = by[cuts[k] : cuts[k + 1]]
                own[rows] = counts[ids[rows] - 2 - first]
        smoothed = model.size - 1 if model.own is not None else model.kinds + 1
        return (own + model.smoothing) / (model.tokens + model.smoothing * smoothed)


def write_words(counts: DataFrame, folder: str, bits: int) -> list[tuple[int, int, str]]:
    """Files of the counts' hashes in order and their counts, cut by the first bits of the hash: bucket, rank of its first word, path."""

    def write(table: pa.Table) -> pa.Table:
        hashes, n = table["hash"].to_numpy(), table["n"].to_numpy()
        by = np.argsort(hashes)
        bucket, path = table["bucket"][0].as_py(), f"{folder}/words-{table['bucket'][0].as_py()}"
        write_file(path, hashes[by].tobytes() + n[by].tobytes())
        return pa.table({"bucket": [bucket], "kinds": [len(by)], "path": [path]})

    bucket = F.shiftright("hash", 64 - bits) + (1 << (bits - 1))
    # One row a file.
    done = counts.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(write, "bucket long, kinds long, path string").toArrow().sort_by("bucket")
    kinds = done["kinds"].to_numpy()
    return list(zip(done["bucket"].to_pylist(), (np.cumsum(kinds) - kinds).tolist(), done["path"].to_pylist(), strict=True))


def pair_counts(train: DataFrame, model, each: int) -> DataFrame:
    """shard, pair (context * size + word), n of the pairs of trie ids in the rows (text); a pair of several slices has several rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_arenas()
        words, size = Words.of(model.value), model.value.size
        for batch in slices(batches, "text", COUNTED_BYTES):
            codes, hashes, bounds = _tokens(batch.column(0))
            ids = words.find(hashes)[1][codes] if len(codes) else np.zeros(0, np.int64)
            contexts, seconds = _with_ends(ids, bounds, size - 1)
            keys, n = np.unique(contexts * size + seconds, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys // (size * each)), pa.array(keys), pa.array(n)], names=["shard", "pair", "n"])

    return train.select("text").mapInArrow(count, "shard long, pair long, n long")


def write_trie(pairs: DataFrame, model, discount: float, folder: str, each: int) -> list[str]:
    """Files of the trie, ``each`` contexts a file with their quantised back-off weights."""

    def write(table: pa.Table) -> pa.Table:
        words, size = Words.of(model.value), model.value.size
        key, n = table["pair"].to_numpy(), table["n"].to_numpy()
        by = np.argsort(key)
        starts = np.flatnonzero(running_starts(key[by]))
        key, n = key[by][starts], np.add.reduceat(n[by], starts)
        context, second = key // size, key % size
        first = table["shard"][0].as_py() * each
        own = context - first
        total = np.bincount(own, n, each)
        weight = discount * np.bincount(own, minlength=each) / np.maximum(total, 1)
        p = np.maximum(n - discount, 0.0) / total[own] + weight[own] * words.unigrams(second)
        back = quantise(np.log10(np.maximum(np.where(total > 0, weight, 1.0), 1e-12)))
        path = f"{folder}/trie-{first}"
        write_file(path, build_shard(context, second, np.log10(p), first, each, size) + back.tobytes())
        return pa.table({"path": [path]})

    # One row a file.
    return pairs.groupBy("shard").applyInArrow(write, "path string").toArrow()["path"].to_pylist()


def score(docs: DataFrame, held_out: Column, limits: ScoreLimits = ScoreLimits(), id_col: str = "doc_id", text_col: str = "text", tag: str = "") -> DataFrame:
    """Learn from the rows not held out, score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    train = rows.where(~F.col("held_out"))
    counts = materialize(word_counts(train), "word-counts", tag)
    totals = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("hash") == int(END_HASH), F.col("n")))).first()
    all_tokens, kinds, ends = totals[0] or 0, totals[1], totals[2] or 0
    folder = local_folder(spark, "ngram-trie", tag)
    bits = max(limits.shards, kinds // FILE_WORDS, 2).bit_length()
    files = write_words(counts, folder, bits)
    size, top, top_ids, own = kinds + 3, None, None, None
    others, other_kinds = 0, 0
    if limits.trie_words is not None:
        frequent = counts.where(F.col("hash") != int(END_HASH)).orderBy(F.desc("n"), "hash").limit(limits.trie_words).toArrow()
        by = np.argsort(frequent["hash"].to_numpy())
        top, top_n = frequent["hash"].to_numpy()[by], frequent["n"].to_numpy()[by]
        top_ids, size = np.arange(len(top)) + 2, limits.vocabulary
        own = np.zeros(size)
        own[1], own[2 : 2 + len(top)] = ends, top_n
        others, other_kinds = all_tokens - own.sum(), max(0, kinds - len(top) - 1)
        own[0] = others
    model = spark.sparkContext.broadcast(Model(files, bits, size, all_tokens, kinds, ends, limits.smoothing, top, top_ids, own))
    each = -(-size // max(limits.shards, all_tokens // FILE_TOKENS))
    paths = spark.sparkContext.broadcast(write_trie(pair_counts(train, model, each), model, limits.discount, folder, each))
    smooth = limits.smoothing
    base_floor = float(np.log10(all_tokens + smooth * (kinds + 1)))
    other_floor = float(np.log10(others + smooth * (other_kinds + 1)))
    end_log = float(np.log10(ends + smooth))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_arenas()
        words = Words.of(model.value)
        if _MAPPED.get("trie", ("",))[0] != folder:
            _MAPPED["trie"] = folder, Trie.mapped(paths.value, size)
        trie = _MAPPED["trie"][1]
        for batch in slices(batches, "text", SCORED_BYTES):
            n = batch.num_rows
            codes, hashes, bounds = _tokens(batch.column(2))
            found, trie_ids = words.find(hashes)
            ids = trie_ids[codes] if len(codes) else np.zeros(0, np.int64)
            contexts, seconds = _with_ends(ids, bounds, size - 1)
            keys, inverse = np.unique(contexts * size + seconds, return_inverse=True)
            context, second = keys // size, keys % size
            p = trie.find(context, second)
            rest = np.flatnonzero(np.isnan(p))
            p[rest] = trie.back_offs(context[rest]) + np.log10(words.unigrams(second[rest]))
            sums = np.concatenate([[0.0], np.cumsum(p[inverse])])
            with_ends = bounds + np.arange(n + 1)
            model_score = sums[with_ends[1:]] - sums[with_ends[:-1]]
            # Sums over each text's words, of all and of those in the class of others.
            per = lambda x: np.diff(np.concatenate([np.zeros(1, x.dtype), np.cumsum(x[codes])])[bounds]) if len(codes) else np.zeros(n, x.dtype)
            log_count, other = np.log10(found + smooth), trie_ids == 0
            n_tokens = np.diff(bounds) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n_tokens),
                    pa.array(per((found > 0).astype(np.int64)) + int(ends > 0)),
                    pa.array(np.full(n, all_tokens, np.int64)),
                    pa.array(per(log_count) + end_log - n_tokens * base_floor),
                    pa.array(model_score + per(np.where(other, log_count - other_floor, 0.0))),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(local, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
