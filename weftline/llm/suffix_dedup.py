"""Removal of repeated 100-byte strings by bucket-pointer refinement over a sparse set of suffixes.

Every string of ``length`` bytes holds an anchor: the q-gram of least hash in it. Equal strings
hold the same anchors at the same places, so only anchored suffixes need sorting.

1. Initial buckets: anchors by q-gram. A bucket of one suffix is settled and leaves.
2. First refinement: suffixes of a bucket are sorted by an identifier (96 bits, from two hashes) of
   their whole surroundings, ``length - q`` bytes before and ``length`` bytes after. All but the
   first of equal ones are copies as a whole and leave with the span around them.
3. A bucket with more surroundings than a task takes is cut into two finer ones, of the strings
   with the anchor near their end and near their start, each by the bytes that its strings then have
   in common; and again, until it fits or holds a single string.
4. Last refinement, exact: the bytes after (and, reversed, before) the anchors get bucket
   identifiers word by word; identifiers of 16, 32, 64 ... bytes are those of the pairs of
   identifiers at the two offsets they consist of. The order they give has the common prefix of each
   two neighbours, and so the bucket of every prefix without another sort. A string around an anchor
   is a pair of such buckets; all but the first of equal pairs are repeats.

Order is (document id, null ids first; rows that repeat an id as they are numbered; offset).
Matches never cross documents. Long texts are searched piece by piece.

Defined cases: a null text is an empty one; texts below ``length`` bytes lose nothing; of rows
that repeat both id and text the one numbered first keeps it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.columnar import bytes_and_offsets, keep_arenas, mix64, plain_strings, ragged_index, running_starts, slices
from weftline.scratch import materialize

LENGTH = 100
GRAM = 24
#: Distinct surroundings of one bucket that a task refines in memory; larger buckets are cut.
BUCKET_ROWS = 50_000
#: Bytes of text that a worker searches at once.
PIECE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bases of the two hashes, and what each adds for a byte.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_TABLES = np.random.default_rng(577215664).integers(1, 2**63, (2, 256), np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 .. n and their inverses, kept for the next piece."""
    if which not in _POWERS or len(_POWERS[which][0]) <= n:
        both = []
        for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            power = np.full(max(n, PIECE + 4096) + 1, base, np.uint64)
            power[0] = 1
            np.multiply.accumulate(power, out=power)
            both.append(power)
        _POWERS[which] = both[0], both[1]
    return _POWERS[which]


class Rolling:
    """64-bit hashes of any byte range of ``data`` from prefix sums."""

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        power, self.inverse = _powers(which, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = best(x[: len(x) - (width - have)], x[width - have :])
    return x


def anchors(rolling: Rolling, offsets: np.ndarray, length: int, gram: int, first: int = 0, stop: int | None = None) -> np.ndarray:
    """Positions of the q-grams of least hash in some string of ``length`` bytes within a document, that starts in first .. stop."""
    n, width = int(offsets[-1]), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64)
    hashes = (rolling.sums[gram:] - rolling.sums[: n + 1 - gram]) * rolling.inverse[: n + 1 - gram]
    order = ((hashes * _ODD) >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
    least = _slide(order, width, np.minimum)
    # A string that crosses documents chooses nothing.
    lengths = np.diff(offsets)
    bad = ragged_index(np.maximum(offsets[:-1], offsets[1:] - (length - 1)), np.minimum(lengths, length - 1))
    least[bad[bad < len(least)]] = 0
    least[:first] = 0
    least[n if stop is None else stop :] = 0
    padded = np.concatenate([np.zeros(width - 1, np.uint32), least, np.zeros(width - 1, np.uint32)])
    return np.flatnonzero(_slide(padded, width, np.maximum) == order)


def _merge_spans(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching spans; by owner and start in order."""
    if not len(owner):
        return owner, start, stop
    by = np.lexsort((start, owner))
    owner, start, stop = owner[by], start[by], stop[by]
    shift = owner * (1 << 40)
    reach = np.maximum.accumulate(stop + shift)
    first = np.ones(len(owner), bool)
    first[1:] = start[1:] + shift[1:] > reach[:-1]
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(owner)) - 1
    return owner[at], start[at], reach[last] - shift[last]


def _keyed(docs: DataFrame, id_col: str, text_col: str, tag: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, uid, text and the extra columns (of the text itself: whether it is null). The uid is 0 if no id repeats; else rows are numbered in a written table."""
    kept = [(F.col(c).isNull() if c == text_col else F.col(c)).alias(f"carry_{i}") for i, c in enumerate(extra)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *kept)
    if rows.groupBy("doc_id").count().where(F.col("count") > 1).isEmpty():
        return rows.withColumn("uid", F.lit(0).cast("long"))
    return materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "numbered-rows", tag)


_SUFFIXES = "copied boolean, gram long, around long, check int, doc_id long, uid long, start int, stop int"


def _suffixes(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchored suffixes, and the spans that are copies of others in the same piece."""
    side, piece = length - gram, PIECE

    def suffixes(data: np.ndarray, offsets: np.ndarray, ids: pa.Array, uid: np.ndarray, base: int, first: int, last: int | None) -> pa.RecordBatch:
        rolling, second = Rolling(data), Rolling(data, 1)
        at = anchors(rolling, offsets, length, gram, first, last)
        owner = np.searchsorted(offsets, at, "right") - 1
        left = np.maximum(offsets[owner], at - side)
        right = np.minimum(offsets[owner + 1], at + length)
        shape = mix64(((at - left) * 4096 + (right - at)).astype(np.uint64))
        bucket = mix64(rolling.of(at, at + gram)).view(np.int64)
        around = mix64(rolling.of(left, right) + shape).view(np.int64)
        check = (mix64(second.of(left, right) + shape) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        # Null ids come first.
        known = np.asarray(ids.is_valid())
        rank = np.lexsort((uid, np.where(known, ids.fill_null(0).to_numpy(), 0), known))
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        by = np.lexsort((at, place[owner], check, around, bucket))
        same = np.zeros(len(by), bool)
        same[1:] = ~(running_starts(bucket[by]) | running_starts(around[by]) | running_starts(check[by]))[1:]
        fresh, copies = by[~same], by[same]
        who, start, stop = _merge_spans(owner[copies], left[copies] - offsets[owner[copies]], right[copies] - offsets[owner[copies]])
        who = np.concatenate([owner[fresh], who])
        none = np.zeros(len(start), np.int64)
        # Settled spans pass through the buckets' shuffle; a scattered bucket number spreads them.
        scattered = mix64(place[who[len(fresh) :]].astype(np.uint64) * _ODD + start.astype(np.uint64) + np.uint64(base)).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(len(who)) >= len(fresh)),
                pa.array(np.concatenate([bucket[fresh], scattered])),
                pa.array(np.concatenate([around[fresh], none])),
                pa.array(np.concatenate([check[fresh], none.astype(np.int32)])),
                ids.take(pa.array(who)),
                pa.array(uid[who]),
                pa.array((np.concatenate([at[fresh] - offsets[owner[fresh]], start]) + base).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(len(fresh), np.int64), stop + base]).astype(np.int32)),
            ],
            names=["copied", "gram", "around", "check", "doc_id", "uid", "start", "stop"],
        )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_arenas()
        for batch in slices(batches, "text", piece):
            data, offsets = bytes_and_offsets(plain_strings(batch.column(2)))
            ids, uid = batch.column(0), batch.column(1).to_numpy()
            if len(data) <= 2 * piece:
                yield suffixes(data, offsets, ids, uid, 0, 0, None)
                continue
            # One long text: pieces of the strings that start in them, with all that surrounds their anchors.
            for begin in range(0, len(data), piece):
                low, high = max(0, begin - side), min(len(data), begin + piece + 2 * length)
                yield suffixes(data[low:high], np.array([0, high - low]), ids, uid, low, begin - low, begin - low + piece)

    return keyed.select("doc_id", "uid", "text").mapInArrow(find, _SUFFIXES)


def _first_refinement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes in; out those with an equal, earlier surrounding (copied), and the first ones of buckets with several surroundings.

    Spans that are settled already (copied, with a stop) pass through; of an anchor that two pieces of a text share one goes on.
    One row is held back between batches: the first of a bucket, until another surrounding follows or not.
    """
    before: tuple | None = None
    held: pa.RecordBatch | None = None
    for batch in batches:
        settled = batch.filter(batch.column(0))
        if settled.num_rows:
            yield settled
        batch = batch.filter(pc.invert(batch.column(0)))
        n = batch.num_rows
        if not n:
            continue
        known = np.asarray(batch.column(4).is_valid())
        columns = [batch.column(k).to_numpy() for k in (1, 2, 3)] + [known, batch.column(4).fill_null(0).to_numpy(), batch.column(5).to_numpy(), batch.column(6).to_numpy()]
        new = []
        for k, x in enumerate(columns):
            differs = running_starts(x)
            differs[0] = before is None or x[0] != before[k]
            new.append(differs)
        before = tuple(x[-1] for x in columns)
        new_gram, new_class = new[0], new[0] | new[1] | new[2]
        again = ~(new_class | new[3] | new[4] | new[5] | new[6])
        firsts = np.flatnonzero(new_class)
        if held is not None and len(firsts):
            if not new_gram[firsts[0]]:
                yield held
            held = None
        opens = new_gram[firsts]
        # The first of a bucket is refined further only if the next first is of the same bucket.
        follows = np.append(~opens[1:], False)
        keep = np.zeros(n, bool)
        keep[firsts[~opens | follows]] = True
        keep |= ~new_class & ~again
        out = batch.filter(pa.array(keep))
        yield out.set_column(0, "copied", pa.array(~new_class[keep]))
        if len(firsts) and opens[-1]:
            held = batch.slice(int(firsts[-1]), 1)
            held = held.set_column(0, "copied", pa.array([False]))


def _ranks(x: np.ndarray) -> np.ndarray:
    """Bucket identifiers in the order of the values."""
    return np.unique(x, return_inverse=True)[1].reshape(x.shape)


def _suffix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of bytes: their order, and the length of the common prefix of each with the one before it there."""
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    ids = _ranks(words)
    while ids.shape[1] > 1:
        # Identifiers at an offset, refined by those at the offset they end at.
        odd = ids[:, ids.shape[1] - ids.shape[1] % 2 :]
        pairs = ids[:, 0 : ids.shape[1] - 1 : 2] * (int(ids.max()) + 1) + ids[:, 1::2]
        ids = np.concatenate([_ranks(pairs), odd], axis=1) if odd.shape[1] else _ranks(pairs)
    by = np.argsort(ids[:, 0], kind="stable")
    common = np.zeros(len(rows), np.int64)
    for i in range(1, len(rows), 16_384):
        differs = rows[by[i : i + 16_384]] != rows[by[i - 1 : i - 1 + len(by[i : i + 16_384])]]
        common[i : i + 16_384] = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    return by, common


class _Prefixes:
    """Buckets of the prefixes of rows of bytes, of any length."""

    def __init__(self, rows: np.ndarray):
        self.by, self.common = _suffix_order(rows)
        nearest = np.maximum(self.common, np.append(self.common[1:], 0))
        #: The longest prefix that each row has in common with another one.
        self.shared = np.empty(len(rows), np.int64)
        self.shared[self.by] = nearest

    def buckets(self, length: int) -> np.ndarray:
        out = np.empty(len(self.by), np.int64)
        out[self.by] = np.cumsum(self.common < length)
        return out


def _last_refinement(length: int, gram: int):
    """Sorted surroundings in, bucket after bucket; out the spans of strings that start earlier too."""
    side = length - gram

    def spans_of(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        column = lambda name: table[name].combine_chunks()
        data, cuts = bytes_and_offsets(column("bytes"))
        left = column("left").to_numpy().astype(np.int64)
        low, high = column("low").to_numpy(), column("high").to_numpy()
        right = np.diff(cuts) - left
        at = cuts[:-1] + left
        padded = np.concatenate([np.zeros(side + 8, np.uint8), data, np.zeros(length + 8, np.uint8)])
        # Whole words of bytes from the anchor on, and from the one before it backwards.
        after = padded[(at + side + 8)[:, None] + np.arange(-(-length // 8) * 8)]
        back = padded[(at + side + 7)[:, None] - np.arange(-(-side // 8) * 8)]
        after, back = _Prefixes(after), _Prefixes(back)
        owners, befores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for before in range(side + 1):
            able = (left >= before) & (right >= length - before) & (low <= before) & (before <= high)
            rows = np.flatnonzero(able & (back.shared >= before) & (after.shared >= length - before))
            if len(rows) < 2:
                continue
            key = back.buckets(before)[rows] * (len(left) + 1) + after.buckets(length - before)[rows]
            by = np.argsort(key, kind="stable")
            again = by[~running_starts(key[by])]
            owners.append(rows[again])
            befores.append(np.full(len(again), before))
        owner, before = np.concatenate(owners), np.concatenate(befores)
        place = column("start").to_numpy().astype(np.int64)
        who, start, stop = _merge_spans(owner, place[owner] - before, place[owner] - before + length)
        take = pa.array(who)
        return pa.RecordBatch.from_arrays(
            [column("doc_id").take(take), column("uid").take(take), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))],
            names=["doc_id", "uid", "start", "stop"],
        )

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_arenas()
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 20_000:
                continue
            table = pa.Table.from_batches(held)
            g = table["key"].combine_chunks().to_numpy()
            cut = int(np.flatnonzero(running_starts(g))[-1])
            if cut:
                yield spans_of(table.slice(0, cut))
            held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        if rows:
            yield spans_of(pa.Table.from_batches(held))

    return refine


_SURROUNDINGS = ("key", "doc_id", "uid", "start", "left", "bytes", "low", "high")


def _surroundings(keyed: DataFrame, chosen: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes around each chosen suffix: key (its bucket), doc_id, uid, start, left (bytes before the anchor), bytes, and low and high: the least and most bytes that its strings have before the anchor."""
    per_doc = chosen.groupBy("doc_id", "uid").agg(F.collect_list("start").alias("starts"), F.collect_list("gram").alias("grams"))
    per_doc = per_doc.select(F.col("doc_id").alias("d"), F.col("uid").alias("u"), "starts", "grams")
    joined = keyed.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("uid") == F.col("u")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_arenas()
        for batch in slices(batches, "text", PIECE):
            data, offsets = bytes_and_offsets(plain_strings(batch.column(4)))
            counts = pc.list_value_length(batch.column(2)).to_numpy()
            start, grams = batch.column(2).flatten().to_numpy().astype(np.int64), batch.column(3).flatten()
            owner = np.repeat(np.arange(batch.num_rows), counts)
            at = offsets[owner] + start
            low = np.maximum(offsets[owner], at - (length - gram))
            high = np.minimum(offsets[owner + 1], at + length)
            for i in range(0, len(at), 20_000):
                part = slice(i, i + 20_000)
                sizes = high[part] - low[part]
                cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                raw = data[ragged_index(low[part], sizes)]
                who = pa.array(owner[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        grams.slice(i, 20_000),
                        batch.column(0).take(who),
                        batch.column(1).take(who),
                        pa.array(start[part].astype(np.int32)),
                        pa.array((at[part] - low[part]).astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(raw)]),
                    ],
                    names=["key", "doc_id", "uid", "start", "left", "bytes"],
                )

    # With all columns, so that the texts are dealt as ``remove_repeats`` needs them and its exchange is this one.
    picked = joined.select("doc_id", "uid", "starts", "grams", "text", *keyed.columns[3:])
    around = picked.mapInArrow(cut, "key long, doc_id long, uid long, start int, left int, bytes binary")
    return around.withColumn("low", F.lit(0)).withColumn("high", F.lit(length - gram))


def _core(length: int) -> Column:
    """The bytes that all strings of a bucket have in common."""
    return F.substring(F.col("bytes"), F.col("left") - F.col("low") + 1, F.col("low") + length - F.col("high"))


def _finer(buckets: DataFrame, length: int) -> DataFrame:
    """Each bucket cut in two by the place of the anchor in its strings."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct(F.col("low").alias("l"), middle.alias("h")), F.struct((middle + 1).alias("l"), F.col("high").alias("h")))
    rows = buckets.withColumn("half", F.explode(halves)).withColumn("low", F.col("half.l")).withColumn("high", F.col("half.h"))
    rows = rows.where((F.col("left") >= F.col("low")) & (F.octet_length("bytes") - F.col("left") >= length - F.col("high")))
    return rows.withColumn("key", F.xxhash64("low", "high", _core(length))).select(*_SURROUNDINGS)


def _fitting(buckets: DataFrame, length: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """Buckets that fit a task, and the spans of single strings whose bucket does not."""
    spans, parts, wide = None, None, buckets
    while True:
        wide = materialize(_finer(wide, length), "finer-buckets", tag)
        large = wide.groupBy("key").count().where(F.col("count") > BUCKET_ROWS).select("key")
        fits = wide.join(large, "key", "left_anti").select(*_SURROUNDINGS)
        parts = fits if parts is None else parts.unionByName(fits)
        wide = wide.join(large, "key", "left_semi").select(*_SURROUNDINGS)
        # Nothing is left to refine where every string has the anchor at the same place: it is the core.
        strings = wide.where("low = high").select(F.sha2(_core(length), 256).alias("string"), "doc_id", "uid", (F.col("start") - F.col("low")).alias("start"))
        first = strings.groupBy("string").agg(F.min(F.struct("doc_id", "uid", "start")).alias("first"))
        again = strings.join(first, "string").where(~F.struct("doc_id", "uid", "start").eqNullSafe(F.col("first")))
        again = again.select("doc_id", "uid", "start", (F.col("start") + length).alias("stop"))
        spans = again if spans is None else spans.unionByName(again)
        wide = wide.where("low < high")
        if wide.isEmpty():
            return parts, spans


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", tag: str = "") -> DataFrame:
    """Spans (doc_id, uid, start, stop) that cover exactly the bytes of strings which also start earlier; they may overlap."""
    return _spans(_keyed(docs, id_col, text_col, tag), length, gram, tag)


def _spans(keyed: DataFrame, length: int, gram: int, tag: str) -> DataFrame:
    """The same for rows (doc_id, uid, text, and any others) of which none repeats id and uid."""
    suffixes = _suffixes(keyed, length, gram).repartition("gram").sortWithinPartitions("gram", "around", "check", "doc_id", "uid", "start")
    settled = materialize(suffixes.mapInArrow(_first_refinement, _SUFFIXES), "refined", tag)
    # The whole surroundings of a copied suffix, or a span settled before.
    whole = F.col("stop") == 0
    low = F.when(whole, F.greatest(F.lit(0), F.col("start") - (length - gram))).otherwise(F.col("start"))
    spans = settled.where("copied").select("doc_id", "uid", low.alias("start"), F.when(whole, F.col("start") + length).otherwise(F.col("stop")).alias("stop"))
    chosen = settled.where(~F.col("copied")).select("gram", "doc_id", "uid", "start")
    large = chosen.groupBy("gram").count().where(F.col("count") > BUCKET_ROWS).select(F.col("gram").alias("key"))
    around = _surroundings(keyed, chosen, length, gram)
    if not large.isEmpty():
        around = materialize(around, "surroundings", tag)
        parts, more = _fitting(around.join(large, "key", "left_semi").select(*_SURROUNDINGS), length, tag)
        around = around.join(large, "key", "left_anti").select(*_SURROUNDINGS).unionByName(parts)
        spans = spans.unionByName(more)
    refined = around.repartition("key").sortWithinPartitions("key", "doc_id", "uid", "start")
    return spans.unionByName(refined.mapInArrow(_last_refinement(length, gram), "doc_id long, uid long, start int, stop int"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), whole_characters: bool = False, tag: str = "") -> DataFrame:
    """Every row with its repeats cut out: doc_id, uid, kept (the bytes that remain), n_bytes, n_removed, n_spans, and the columns in ``carry``.

    ``whole_characters``: a character that loses a byte goes whole, so what remains is valid UTF-8.
    """
    keyed = _keyed(docs, id_col, text_col, tag, carry)
    names = [f"carry_{i}" for i in range(len(carry))]
    keyed = keyed.select("doc_id", "uid", "text", *names)
    spans = _spans(keyed, length, gram, tag)
    per_doc = spans.groupBy("doc_id", "uid").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    per_doc = per_doc.select(F.col("doc_id").alias("d"), F.col("uid").alias("u"), "starts", "stops")
    joined = keyed.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("uid") == F.col("u")), "left")
    joined = joined.select("doc_id", "uid", "text", "starts", "stops", *names)
    texts = {n for n, c in zip(names, carry, strict=True) if c == text_col}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_arenas()
        for batch in slices(batches, "text", PIECE):
            data, offsets = bytes_and_offsets(plain_strings(batch.column(2)))
            counts = pc.fill_null(pc.list_value_length(batch.column(3)), 0).to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), counts)
            begin = offsets[owner] + batch.column(3).flatten().to_numpy()
            end = np.minimum(offsets[owner] + batch.column(4).flatten().to_numpy(), offsets[owner + 1])
            owner, begin, end = _merge_spans(owner, begin, end)
            if whole_characters:
                # A character has at most three bytes after its first.
                for _ in range(3):
                    begin = begin - ((data[begin] & 0xC0) == 0x80)
                    inner = np.flatnonzero(end < offsets[owner + 1])
                    end[inner] += (data[end[inner]] & 0xC0) == 0x80
                owner, begin, end = _merge_spans(owner, begin, end)
            edge = np.zeros(len(data) + 1, np.int8)
            edge[begin] += 1
            edge[end] -= 1
            gone = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
            removed = np.bincount(owner, end - begin, batch.num_rows).astype(np.int64)
            sizes = np.diff(offsets)
            cuts = np.concatenate([[0], np.cumsum(sizes - removed)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data[~gone]))]),
                    pa.array(sizes),
                    pa.array(removed),
                    pa.array(np.bincount(owner, minlength=batch.num_rows)),
                    *(pc.replace_with_mask(batch.column(2), x, pa.scalar(None, pa.string())) if n in texts else x for n, x in zip(names, batch.columns[5:], strict=True)),
                ],
                names=["doc_id", "uid", "kept", "n_bytes", "n_removed", "n_spans", *names],
            )

    schema = "doc_id long, uid long, kept binary, n_bytes long, n_removed long, n_spans long"
    types = {f.name: "string" if f.name in texts else f.dataType.simpleString() for f in joined.schema}
    out = joined.mapInArrow(cut, ", ".join([schema, *(f"{n} {types[n]}" for n in names)]))
    return out.select("doc_id", "uid", "kept", "n_bytes", "n_removed", "n_spans", *(F.col(n).alias(c) for n, c in zip(names, carry, strict=True)))


def digests(cut: DataFrame) -> DataFrame:
    """One row a document with the digest of what remains."""
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The query's rows in DuckDB SQL, over the view ``documents`` with unique ids: every 100-byte string by itself.
ORACLE = r"""
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
sized AS (SELECT doc_id, hex(raw) AS h, octet_length(raw) AS n FROM docs),
strings AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM sized WHERE n >= 100)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, i) AS k FROM strings) WHERE k > 1),
opened AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS opens FROM again),
runs AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM opened),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT s.doc_id, s.a, coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0) AS from_, z.h FROM spans s JOIN sized z ON s.doc_id IS NOT DISTINCT FROM z.doc_id
),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS part FROM gaps GROUP BY doc_id),
totals AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM spans GROUP BY doc_id)
SELECT z.doc_id, z.n AS n_bytes, coalesce(t.n_removed, 0)::BIGINT AS n_removed, coalesce(t.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k.part, '') || substr(z.h, 2 * coalesce(t.last, 0) + 1))) AS kept_sha256
FROM sized z LEFT JOIN totals t ON z.doc_id = t.doc_id LEFT JOIN kept k ON z.doc_id = k.doc_id
"""
