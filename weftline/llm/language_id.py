"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary, learned from a
bounded sample of its labelled texts. A word's probability in a language is the sum over all
its segmentations into pieces, by the forward algorithm; a text's, the product over its words,
each lower-cased and led by the blank mark.

Where no piece reaches over a place in a word the sum is a product of two, so long unspaced runs
are cut there and their parts go side by side.

Probabilities are learned from the library's best segmentation of a bounded sample of the labelled
texts: ``texts_per_language`` texts of a language in expectation, chosen by a hash of id and text. Every label
that the training rows have is a language. ``group`` languages at a time are sent to the workers and
scored; more languages are more passes over the same batches. The score is the posterior under equal
priors; it nears 1 on long texts, since their words are taken as independent.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; without any
labelled text every row is; repeated rows are predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.columnar import bytes_and_offsets, encode_words, keep_arenas, mix64, plain_strings, slices, split_words
from weftline.scratch import materialize

_MARK = 0x2581
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PIECES: dict[str, Pieces] = {}


@dataclass(frozen=True)
class LanguageLimits:
    texts_per_language: int = 4000
    #: Languages that one pass scores; its table has that many numbers for each piece.
    group: int = 64
    #: Count that every piece is thought to have in every language.
    smoothing: float = 0.1
    #: Probability of a character that no piece covers.
    unknown: float = 1e-9


class Pieces:
    """The vocabulary's pieces, and their beginnings, by a hash of their code points."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        plain = [i for i in range(len(names)) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        self.size = len(names)
        self.longest = max(len(names[i]) for i in plain)
        known = {names[i]: i for i in plain}
        begun = {x[:k] for x in known for k in range(1, len(x))}
        every = sorted(known.keys() | begun)
        keys = np.zeros(len(every), np.uint64)
        for k in range(self.longest):
            rows = np.array([i for i, x in enumerate(every) if len(x) > k], np.int64)
            keys[rows] = self.extend(keys[rows], np.array([ord(every[i][k]) for i in rows.tolist()]))
        self.bits = (4 * len(every)).bit_length()
        self.keys = np.zeros(1 << self.bits, np.uint64)
        #: Id of the piece, -1 where there is none; and whether a longer one begins so.
        self.ids, self.more = np.full(1 << self.bits, -1, np.int32), np.zeros(1 << self.bits, bool)
        self.used = np.zeros(1 << self.bits, bool)
        for key, slot, x in zip(keys, (keys >> np.uint64(64 - self.bits)).tolist(), every, strict=True):
            while self.used[slot]:
                slot = (slot + 1) & (len(self.ids) - 1)
            self.keys[slot], self.ids[slot], self.more[slot], self.used[slot] = key, known.get(x, -1), x in begun, True

    @staticmethod
    def extend(keys: np.ndarray, points: np.ndarray) -> np.ndarray:
        return mix64(keys * _STEP + points.astype(np.uint64) + np.uint64(1))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id of the piece with each key (-1 for none), and whether longer ones begin so."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[slot] != keys) & self.used[slot])
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.ids) - 1)
            open_ = open_[(self.keys[slot[open_]] != keys[open_]) & self.used[slot[open_]]]
        hit = self.used[slot] & (self.keys[slot] == keys)
        return np.where(hit, self.ids[slot], -1), hit & self.more[slot]


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


#: Characters whose sums are worked on at once.
BLOCK = 100_000


def forward(words: pa.Array, vocabulary: Pieces, table: np.ndarray, unknown: float) -> np.ndarray:
    """Log probability [words, languages], summed over all segmentations of the mark and the word.

    ``table``: probabilities [pieces, languages].
    """
    wide, cuts = bytes_and_offsets(pc.cast(words, pa.string()))
    points = np.frombuffer(wide.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((wide & 0xC0) != 0x80)])[cuts]
    points = np.insert(points, begins[:-1], _MARK)
    begins = begins + np.arange(len(begins))
    out = np.zeros((len(words), table.shape[1]))
    table = np.concatenate([table, np.full((1, table.shape[1]), unknown)])
    at = 0
    while at < len(words):
        stop = max(at + 1, int(np.searchsorted(begins, begins[at] + BLOCK, "right")) - 1)
        out[at:stop] = _forward_block(points[begins[at] : begins[stop]], begins[at : stop + 1] - begins[at], vocabulary, table)
        at = stop
    return out


def _occurrences(points: np.ndarray, cuts: np.ndarray, vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and id of every piece in the words that begin at ``cuts``; characters without a piece have the id after the last."""
    ends = np.repeat(cuts[1:], np.diff(cuts))
    live, keys = np.arange(len(points)), np.zeros(len(points), np.uint64)
    starts, lengths, ids = [], [], []
    for k in range(1, vocabulary.longest + 1):
        inside = live + k <= ends[live]
        live, keys = live[inside], keys[inside]
        if not len(live):
            break
        keys = vocabulary.extend(keys, points[live + k - 1])
        found, more = vocabulary.find(keys)
        if k == 1:
            found = np.where(found < 0, vocabulary.size, found)
        hit = found >= 0
        starts.append(live[hit])
        lengths.append(np.full(int(hit.sum()), k))
        ids.append(found[hit])
        live, keys = live[more], keys[more]
    return np.concatenate(starts), np.concatenate(lengths), np.concatenate(ids)


def _forward_block(points: np.ndarray, cuts: np.ndarray, vocabulary: Pieces, table: np.ndarray) -> np.ndarray:
    n, languages = len(points), table.shape[1]
    start, length, ids = _occurrences(points, cuts, vocabulary)
    # Places that a piece reaches over; at the others words fall into parts.
    over = np.bincount(start + 1, minlength=n + 2) - np.bincount(start + length, minlength=n + 2)
    first = np.cumsum(over)[:n] == 0
    first[cuts[:-1]] = True
    part = np.cumsum(first) - 1
    opens = np.flatnonzero(first)
    sizes = np.diff(np.append(opens, n))
    # Sums after 0 .. size characters of each part, one part after the other.
    base = opens + np.arange(len(opens))
    alpha = np.zeros((n + len(opens), languages))
    alpha[base] = 1.0
    scale = np.zeros(len(opens))
    own = part[start]
    end = start + length - opens[own]
    by = np.lexsort((own, end))
    own, end, length, ids = own[by], end[by], length[by], ids[by]
    stops = np.searchsorted(end, np.arange(1, int(sizes.max()) + 2))
    for t, (a, b) in enumerate(zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True), 1):
        who = own[a:b]
        heads = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        total = np.add.reduceat(alpha[base[who] + t - length[a:b]] * table[ids[a:b]], heads, axis=0)
        who = who[heads]
        alpha[base[who] + t] = total
        low = who[total.max(1) < 1e-80]
        if len(low):
            for back in range(min(vocabulary.longest, t) + 1):
                alpha[base[low] + t - back] *= 1e80
            scale[low] -= 80 * np.log(10)
    each = np.log(np.maximum(alpha[base + sizes], 1e-300)) + scale[:, None]
    return np.add.reduceat(each, part[cuts[:-1]], axis=0)


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(plain_strings(column))


def learn(train: DataFrame, model_path: str, limits: LanguageLimits, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], DataFrame]:
    """Languages, and the counts (lang, piece, n) of their pieces, from the labelled rows of ``train``."""
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    labelled = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    # One row a language.
    languages = sorted(r["lang"] for r in labelled.select("lang").collect())
    # A row's place between 0 and 1; the id keeps copies of one text apart.
    place = F.shiftrightunsigned(F.xxhash64("id", "text"), 11) * F.lit(2.0**-53)
    small = F.broadcast(labelled) if len(languages) <= SENT else labelled
    sample = rows.join(small, "lang").where(place * F.col("rows") < limits.texts_per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model_path)
        for batch in slices(batches, "text", 2 << 20):
            langs = np.asarray(batch.column(0).to_pylist(), object)
            texts = _lowered(batch.column(1))
            for lang in np.unique(langs.astype(str)).tolist():
                words, _ = split_words(texts.filter(pa.array(langs == lang)))
                codes, distinct = encode_words(words)
                times = np.bincount(codes, minlength=len(distinct)) if len(codes) else np.zeros(0, np.int64)
                found = vocabulary.library.encode(distinct.to_pylist(), num_threads=1)
                flat = np.fromiter((i for x in found for i in x), np.int64)
                total = np.bincount(flat, np.repeat(times, [len(x) for x in found]), vocabulary.size) if len(flat) else np.zeros(vocabulary.size)
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(used)), pa.array(used), pa.array(total[used])], names=["lang", "piece", "n"])

    return languages, sample.mapInArrow(count, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def probabilities(counts: DataFrame, languages: list[str], size: int, limits: LanguageLimits) -> np.ndarray:
    """Smoothed [pieces, languages] of one group of languages; its size is bounded by ``group``."""
    summed = counts.where(F.col("lang").isin(languages)).toArrow()
    table = np.full((size, len(languages)), limits.smoothing)
    at = {x: i for i, x in enumerate(languages)}
    np.add.at(table, (summed["piece"].to_numpy(), np.array([at[x] for x in summed["lang"].to_pylist()], np.int64)), summed["n"].to_numpy())
    return table / table.sum(0)


#: Languages whose row counts are broadcast for the sample; more are joined by a shuffle.
SENT = 10_000
_STATE = "lang_pred string, best double, total double"


def predict(docs: DataFrame, groups: Iterable[tuple[list[str], np.ndarray]], model_path: str, limits: LanguageLimits, id_col: str, text_col: str, carry: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, the columns in ``carry``, lang_pred and score (posterior under equal priors) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *carry, F.col(text_col).alias("text"))
    # The best language so far, its log probability, and the logarithm of the sum of all.
    rows = rows.select("*", F.lit("und").alias("lang_pred"), F.lit(None).cast("double").alias("best"), F.lit(None).cast("double").alias("total"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("lang_pred", "best", "total"))
    for group in groups:
        rows = rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(group), model_path, limits), f"{kept}, {_STATE}")
    return rows.select(*(c for c in rows.columns if c not in ("text", "best", "total")), F.coalesce(F.exp(F.col("best") - F.col("total")), F.lit(0.0)).alias("score"))


def _scored(shared, model_path: str, limits: LanguageLimits):
    """A pass over the batches for one group of languages."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_arenas()
        vocabulary = pieces(model_path)
        names, table = shared.value
        for batch in slices(batches, "text", 2 << 20):
            state = batch.num_columns - 3
            raw = plain_strings(batch.column(state - 1))
            letters = pc.match_substring_regex(raw, r"\p{L}").to_numpy(zero_copy_only=False)
            n = batch.num_rows
            words, bounds = split_words(_lowered(raw))
            codes, distinct = encode_words(words)
            each = forward(distinct, vocabulary, table, limits.unknown) if len(distinct) else np.zeros((0, len(names)))
            total = np.zeros((n, len(names)))
            for k in range(len(names)):
                sums = np.concatenate([[0.0], np.cumsum(each[codes, k])]) if len(codes) else np.zeros(1)
                total[:, k] = sums[bounds[1:]] - sums[bounds[:-1]]
            top = total.max(1)
            every = top + np.log(np.exp(total - top[:, None]).sum(1))
            before = [pc.fill_null(batch.column(state + k), -np.inf).to_numpy(zero_copy_only=False) for k in (1, 2)]
            label = pc.if_else(pa.array(letters & (top > before[0])), pa.array(names).take(pa.array(total.argmax(1))), batch.column(state))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:state], label, pa.array(np.maximum(top, before[0]), mask=~letters), pa.array(np.logaddexp(every, before[1]), mask=~letters)],
                names=batch.schema.names,
            )

    return score


def identify(docs: DataFrame, held_out: Column, model_path: str, limits: LanguageLimits = LanguageLimits(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", tag: str = "") -> DataFrame:
    """Learn from the rows that are not held out and predict all: doc_id, held_out, lang_pred, score."""
    languages, counts = learn(docs.where(~held_out), model_path, limits, id_col, text_col, lang_col)
    counts = materialize(counts, "piece-counts", tag)
    size = pieces(model_path).size
    names = (languages[i : i + limits.group] for i in range(0, len(languages), limits.group))
    groups = ((group, probabilities(counts, group, size, limits)) for group in names)
    return predict(docs, groups, model_path, limits, id_col, text_col, (held_out.alias("held_out"),))
