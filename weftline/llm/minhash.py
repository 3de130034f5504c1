"""Near-duplicate classes by BagMinHash over 5-word shingles.

A document is a bag: its shingles with their counts. Signatures follow hierarchical Poisson
processes over the discretised weights: the weight axis is cut into (0,1], (1,2], (2,4], (4,8] ...;
each shingle draws, for every cut its count reaches into, points in ascending time whose rate is
the cut's width, each with a register and a level on the weight axis; points above the count are
rejected. A register keeps the earliest point. A document stops as soon as the next points lie
beyond its latest register. Registers of two bags agree with their weighted Jaccard similarity.

Bands of registers propose pairs. Exact copies collapse to one text first. Each member of a band
bucket is compared with the bucket's busiest member, and the links make classes. In buckets that
then hold several classes, all pairs of different classes are compared where they lie: chunks of
the bucket meet in pairs, a task filters them by size and by the registers that agree, and
counts the exact multiset overlap of what remains. Only links leave a task, at most as many as join
its classes, so no list of pairs is ever written. A link needs an exact weighted Jaccard similarity
of the two bags of at least ``similarity``.

A pair at the similarity of 0.8 shares a band with probability 1 - (1 - 0.8^6)^20 = 0.9977, one of
0.85 with 0.99997. The register filter drops it with a probability below 1e-4.

Defined cases: texts below ``words`` words are one shingle; a null text, and one without words,
is a class of its own; repeated rows share their class; null ids keep theirs; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.columnar import bytes_and_offsets, encode_words, hash_strings, keep_arenas, mix64, plain_strings, ragged_index, running_starts, slices, split_words
from weftline.scratch import materialize, sweep


@dataclass(frozen=True)
class NearLimits:
    words: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 6
    #: Members, and bytes of their bags, in one chunk of a bucket, as a mean.
    chunk_rows: int = 1024
    chunk_bytes: int = 4 << 20

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def least_agreeing(self) -> int:
        """Registers that a pair of the similarity has in common, but for four standard deviations."""
        m, p = self.registers, self.similarity
        return int(m * p - 4 * (m * p * (1 - p)) ** 0.5)


_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Text bytes that a worker signs at once, and bytes of bags that it compares at once.
SLICE, HELD = 1 << 20, 4 << 20
#: Hashes of texts that are broadcast (8 bytes each); more go by a shuffle join alone.
SENT = 2_000_000


def shingle_bags(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes (sorted in each document), their counts, and each document's offsets."""
    split, bounds = split_words(texts)
    codes, distinct = encode_words(split)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    own = hash_strings(distinct)[codes]
    sizes = np.diff(bounds)
    count = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    start = ragged_index(bounds[:-1], count)
    owner = np.repeat(np.arange(len(texts)), count)
    span = np.minimum(words, sizes)[owner]
    grams = np.zeros(len(start), np.uint64)
    for k in range(words):
        inside = k < span
        grams[inside] = mix64(grams[inside] * _STEP + own[start[inside] + k])
    by = np.lexsort((grams, owner))
    grams, owner = grams[by], owner[by]
    first = running_starts(grams) | running_starts(owner)
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(grams)))
    return grams[at], counts, np.searchsorted(owner[at], np.arange(len(texts) + 1))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from the high bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def bag_minhash(grams: np.ndarray, counts: np.ndarray, offsets: np.ndarray, registers: int) -> np.ndarray:
    """Signatures [documents, registers] of float64 times; infinite only for empty bags."""
    n = len(offsets) - 1
    best = np.full((n, registers), np.inf)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    # Cut k of the weight axis is (low, low + width]: (0,1], (1,2], (2,4], (4,8] ...
    cuts = np.where(counts > 1, np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1, 1)
    item = np.repeat(np.arange(len(grams)), cuts)
    cut = ragged_index(np.zeros(len(cuts)), cuts)
    width = np.where(cut < 2, 1.0, 2.0 ** (cut - 1))
    low = np.where(cut == 0, 0.0, np.where(cut == 1, 1.0, 2.0 ** (cut - 1)))
    doc, top = owner[item], counts[item].astype(np.float64)
    state = mix64(grams[item] + cut.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    time = np.zeros(len(item))
    flat = best.ravel()
    live = np.arange(len(item))
    limit = np.full(n, np.inf)
    # The earliest points of a document fill its registers: a first limit spares it the late ones.
    total = np.zeros(n)
    np.add.at(total, doc, np.minimum(width, np.maximum(top - low, 0)))
    guess = (np.log(registers) + 7.0) / np.maximum(total, 1e-9) / 1.0
    pending = np.zeros(0, np.int64)
    while len(live) or len(pending):
        if not len(live):
            # Documents whose first limit was too low go on without one.
            short = np.isinf(best).any(1)
            guess = np.where(short, np.inf, guess)
            limit = best.max(1)
            live = pending[time[pending] <= limit[doc[pending]]]
            pending = np.zeros(0, np.int64)
            fresh = live
        else:
            state[live] = mix64(state[live] + _STEP)
            time[live] += -np.log(_uniform(state[live])) / (registers * width[live])
            fresh = live
        late = time[fresh] > guess[doc[fresh]]
        pending = np.concatenate([pending, fresh[late]])
        fresh = fresh[~late]
        fresh = fresh[time[fresh] <= limit[doc[fresh]]]
        place = mix64(state[fresh] ^ np.uint64(0xA0761D6478BD642F))
        level = low[fresh] + width[fresh] * _uniform(mix64(place + _STEP))
        hit = level <= top[fresh]
        slot = doc[fresh[hit]] * registers + (place[hit] % np.uint64(registers)).astype(np.int64)
        np.minimum.at(flat, slot, time[fresh[hit]])
        touched = np.unique(doc[fresh[hit]])
        limit[touched] = best[touched].max(1)
        live = fresh[time[fresh] <= limit[doc[fresh]]]
    return best


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band; equal keys: equal registers in the same band."""
    parts = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    key = np.zeros((len(signatures), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        key = mix64(key * _STEP + parts[:, :, k])
    return key.view(np.int64)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two bags as sets of tagged shingles: sum of least counts over sum of greatest."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def tagged(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each shingle once for every count, told apart by its number, so a bag is a set."""
    return mix64(np.repeat(grams, counts) + ragged_index(np.zeros(len(counts)), counts).astype(np.uint64) * _STEP)


_WORDS = r"[^\x20\x09-\x0D]"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, digest (SHA-256 of the text) of the rows with words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _signed(rows: DataFrame, limits: NearLimits) -> DataFrame:
    """digest, size (shingles), keys (band keys), marks (a byte of each register) of the texts with words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_arenas()
        for batch in slices(batches, "text", SLICE):
            grams, counts, offsets = shingle_bags(plain_strings(batch.column(1)), limits.words)
            signatures = bag_minhash(grams, counts, offsets, limits.registers)
            keys = band_keys(signatures, limits.bands, limits.rows)
            marks = (mix64(signatures.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)
            full = np.flatnonzero(np.diff(offsets) > 0)
            ends = np.arange(len(full) + 1, dtype=np.int32)
            total = np.concatenate([[0], np.cumsum(counts)])[offsets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(full)),
                    pa.array(np.diff(total)[full]),
                    pa.ListArray.from_arrays(pa.array(ends * limits.bands), pa.array(keys[full].ravel())),
                    _binaries(marks[full].ravel(), ends.astype(np.int64) * limits.registers),
                ],
                names=["digest", "size", "keys", "marks"],
            )

    return rows.select("digest", "text").mapInArrow(sign, "digest binary, size long, keys array<long>, marks binary")


def _binaries(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _bags(rows: DataFrame, limits: NearLimits) -> DataFrame:
    """node, bag: its tagged shingles, as bytes."""

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_arenas()
        for batch in slices(batches, "text", SLICE):
            grams, counts, offsets = shingle_bags(plain_strings(batch.column(1)), limits.words)
            cuts = np.concatenate([[0], np.cumsum(counts)])[offsets] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), _binaries(tagged(grams, counts).view(np.uint8), cuts)], names=["node", "bag"])

    return rows.select("node", "text").mapInArrow(bag, "node long, bag binary")


def _shared(data: np.ndarray, cuts: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many numbers the sets ``left[i]`` and ``right[i]`` share; ``data``: dense numbers, ``cuts``: bounds of the sets."""
    out = np.zeros(len(left), np.int64)
    by = np.argsort(left, kind="stable")
    starts = np.flatnonzero(running_starts(left[by]))
    seen = np.zeros(int(data.max()) + 1 if len(data) else 1, bool)
    sizes = np.diff(cuts)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(by)], strict=True):
        rows = by[a:b]
        own = data[cuts[left[rows[0]]] : cuts[left[rows[0]] + 1]]
        seen[own] = True
        count = sizes[right[rows]]
        hits = seen[data[ragged_index(cuts[right[rows]], count)]]
        out[rows] = np.add.reduceat(hits, np.cumsum(count) - count, dtype=np.int64)
        seen[own] = False
    return out


def _compare(pairs: DataFrame, bags: DataFrame, limits: NearLimits) -> DataFrame:
    """a, b of the pairs (pivot, node) that are links."""
    left = bags.select(F.col("node").alias("pivot"), F.col("bag").alias("pivot_bag"))
    joined = pairs.join(left, "pivot").join(bags, "node").select("pivot", "node", "pivot_bag", "bag")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [weighted_jaccard(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) >= limits.similarity for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return joined.mapInArrow(score, "a long, b long")


class _Forest:
    """Classes of one task's roots, as far as its links have joined them."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[x] = y
        return x != y


def _links_within(limits: NearLimits):
    """Sorted rows (key, i, j, chunk, node, root, size, marks, bag) in, meeting after meeting; out links between different roots."""
    block = 100_000

    def links_of(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        column = lambda name: table[name].combine_chunks()
        key, i, j, chunk, node, size = (column(n).to_numpy() for n in ("key", "i", "j", "chunk", "node", "size"))
        _, root = np.unique(column("root").to_numpy(), return_inverse=True)
        marks = bytes_and_offsets(column("marks"))[0].reshape(len(key), limits.registers)
        raw, cuts = bytes_and_offsets(column("bag"))
        # The same numbers for the same shingles in all of the table.
        _, data = np.unique(np.frombuffer(raw.tobytes(), np.uint64), return_inverse=True)
        cuts = cuts // 8
        band = column("band").to_numpy()
        starts = np.flatnonzero(running_starts(key) | running_starts(i) | running_starts(j))
        stops = np.append(starts[1:], len(key))
        # Within a meeting, members of the first chunk come before those of the second.
        split = np.array([a + int(np.count_nonzero(chunk[a:b] == i[a])) for a, b in zip(starts, stops, strict=True)], np.int64)
        own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
        first = np.flatnonzero(np.arange(len(key)) < split[own])
        begin = np.where(i[first] == j[first], first + 1, split[own[first]])
        count = np.maximum(stops[own[first]] - begin, 0)
        ends = np.cumsum(count)
        forest, found = _Forest(int(root.max()) + 1 if len(root) else 0), []
        at = 0
        while at < len(first):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, "right")))
            x, y = np.repeat(first[at:stop], count[at:stop]), ragged_index(begin[at:stop], count[at:stop])
            at = stop
            able = root[x] != root[y]
            able &= np.minimum(size[x], size[y]) >= limits.similarity * np.maximum(size[x], size[y])
            x, y = x[able], y[able]
            for k in range(0, len(x), block):
                a, b = x[k : k + block], y[k : k + block]
                same = marks[a] == marks[b]
                able = same.sum(1) >= limits.least_agreeing
                a, b, same = a[able], b[able], same[able]
                # A pair that shares several bands is compared in the first of them.
                earliest = same.reshape(-1, limits.bands, limits.rows).all(2).argmax(1)
                able = earliest == band[a]
                a, b = a[able], b[able]
                if not len(a):
                    continue
                shared = _shared(data, cuts, a, b)
                able = shared >= limits.similarity * (size[a] + size[b] - shared)
                for p, q in zip(a[able].tolist(), b[able].tolist(), strict=True):
                    if forest.join(int(root[p]), int(root[q])):
                        found.append((p, q))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_arenas()
        held: list[pa.RecordBatch] = []
        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            total += batch.nbytes
            if total < HELD:
                continue
            table = pa.Table.from_batches(held)
            key, i, j = (table[n].combine_chunks().to_numpy() for n in ("key", "i", "j"))
            cut = int(np.flatnonzero(running_starts(key) | running_starts(i) | running_starts(j))[-1])
            if cut:
                yield links_of(table.slice(0, cut))
            rest = table.slice(cut).combine_chunks()
            held, total = rest.to_batches(), rest.nbytes
        if held:
            yield links_of(pa.Table.from_batches(held))

    return work


def _fingerprint(edges: DataFrame) -> tuple:
    """Number and summed hashes of distinct edges: equal for equal sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, tag: str = "") -> DataFrame:
    """node, root (least node of its component) for all nodes of the links, by large-star and small-star rounds."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "edges", tag)
    mark = _fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), "edges", tag)
        before, mark = mark, _fingerprint(edges)
        if mark == before:
            break
    # A star to the least node of each component is all that is left.
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _meetings(placed: DataFrame, signed: DataFrame, bags: DataFrame, limits: NearLimits) -> DataFrame:
    """Links between the classes of each bucket of ``placed`` (key, band, node, root)."""
    kinds = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum("size").alias("bytes"))
    mixed = kinds.where("low <> high")
    chunks = F.ceil(F.greatest(F.col("n") / limits.chunk_rows, F.col("bytes") * 8 / limits.chunk_bytes)).cast("int")
    members = placed.join(mixed.select("key", chunks.alias("chunks")), "key")
    members = members.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # Chunk c meets the chunks 0 .. c as second, and c .. as first.
    partner = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    members = members.select("*", partner.alias("other"))
    members = members.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "band", "node", "root", "size")
    full = members.join(signed.select("node", "marks"), "node").join(bags, "node")
    full = full.select("key", "i", "j", "chunk", "band", "node", "root", "size", "marks", "bag")
    return full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "chunk", "node").mapInArrow(_links_within(limits), "a long, b long")


def near_classes(docs: DataFrame, limits: NearLimits = NearLimits(), id_col: str = "doc_id", text_col: str = "text", tag: str = "") -> tuple[DataFrame, DataFrame]:
    """digest, node of every distinct text with words; node, root of those that link to another."""
    rows = _texts(docs, id_col, text_col)
    work = f"{tag} near {uuid.uuid4().hex}"
    signed = _signed(rows, limits).groupBy("digest").agg(*(F.first(c).alias(c) for c in ("size", "keys", "marks")))
    signed = materialize(signed.withColumn("node", F.monotonically_increasing_id()), "signatures", work)
    keys = signed.select("node", "size", F.posexplode("keys").alias("band", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(keys.join(shared, "key"), "buckets", work)
    busy = members.groupBy("node").agg(F.sum("n").alias("degree"))
    busy = materialize(busy.join(signed.select("node", "digest"), "node"), "busy", work)
    if busy.count() <= SENT:
        # Most texts share no bucket: with a small list of those that do, the others never enter a shuffle.
        sent = F.broadcast(busy.select(F.xxhash64("digest").alias("h")))
        rows = rows.join(sent, F.xxhash64("digest") == F.col("h"), "left_semi")
    texts = rows.join(busy.select("node", "digest"), "digest").groupBy("node").agg(F.first("text").alias("text"))
    bags = materialize(_bags(texts, limits), "bags", work)

    # The pivot of a bucket is its busiest member; among equals the digest decides, so runs agree.
    ranked = members.join(busy, "node").groupBy("key").agg(F.max(F.struct("degree", "digest", "node", "size")).alias("p"))
    pivots = ranked.select("key", F.col("p.node").alias("pivot"), F.col("p.size").alias("pivot_size"))
    alike = F.least("size", "pivot_size") >= limits.similarity * F.greatest("size", "pivot_size")
    pairs = members.join(pivots, "key").where((F.col("node") != F.col("pivot")) & alike).select("pivot", "node").distinct()
    links = materialize(_compare(pairs, bags, limits), "links", work)
    roots = components(links, work)
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialize(placed.select("key", "band", "node", "root", "size"), "placed", work)
    more = materialize(_meetings(placed, signed, bags, limits), "more-links", work)
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")
    roots = materialize(components(stars.unionByName(more), work), "roots", tag)
    nodes = materialize(signed.select("digest", "node"), "nodes", tag)
    sweep(docs.sparkSession, work)
    return nodes, roots


def near_duplicates(docs: DataFrame, limits: NearLimits = NearLimits(), id_col: str = "doc_id", text_col: str = "text", tag: str = "") -> DataFrame:
    """Every row: doc_id, class_id (least doc_id of its class), copies (rows of the same text)."""
    nodes, roots = near_classes(docs, limits, id_col, text_col, tag)
    rows = _texts(docs, id_col, text_col)
    worded = F.regexp_like("text", F.lit(_WORDS))
    rows = materialize(rows.select("doc_id", F.when(worded, F.col("digest")).alias("digest")), "digests", tag)
    same = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    same = same.join(nodes, "digest").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = same.groupBy("root").agg(F.min("least").alias("class_id"))
    same = same.join(least, "root").select("digest", "class_id", "copies")
    found = rows.where("digest is not null").join(same, "digest").select("doc_id", "class_id", "copies")
    alone = rows.where("digest is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies"))
    return found.unionByName(alone)


def keep_one(docs: DataFrame, limits: NearLimits = NearLimits(), id_col: str = "doc_id", text_col: str = "text", tag: str = "") -> DataFrame:
    """The documents without the near-duplicates of others: of each class, the row of least id (of repeated rows, one) stays, with all columns."""
    nodes, roots = near_classes(docs, limits, id_col, text_col, tag)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The rows travel as one struct, so no column of theirs can clash with the keys.
    worded = docs.where(text.rlike(_WORDS)).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    same = worded.groupBy("digest").agg(F.min("id").alias("least"))
    same = same.join(nodes, "digest").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # One text a class: that of the least id; ties and null ids go by the text's digest.
    best = same.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("n"), F.col("least").alias("d"), F.col("digest").alias("t"))).alias("best"))
    best = best.select(F.col("best.t").alias("digest"), F.col("best.d").alias("d"))
    kept = worded.join(best, "digest").where(F.col("id").eqNullSafe(F.col("d")))
    # Rows that repeat id and text: only such pairs reach the window.
    counted = kept.groupBy("digest").agg(F.count("*").alias("c"))
    once = kept.join(counted.where("c = 1"), "digest", "left_semi")
    again = kept.join(counted.where("c > 1"), "digest", "left_semi")
    again = again.withColumn("r", F.row_number().over(Window.partitionBy("digest").orderBy("row"))).where("r = 1")
    out = once.select("row.*").unionByName(again.select("row.*"))
    return out.unionByName(docs.where(~text.rlike(_WORDS)))


#: The query's rows in DuckDB SQL, over the view ``documents``: exact similarities of all texts that share a shingle.
ORACLE = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words FROM documents
),
texts AS (SELECT row_number() OVER (ORDER BY text) AS t, * FROM (SELECT text, any_value(words) AS words, min(doc_id) AS least, count(*) AS copies FROM docs WHERE len(words) > 0 GROUP BY text)),
grams AS (
  SELECT t, array_to_string(words[i:i+4], ' ') AS g FROM (SELECT t, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM texts)
),
bags AS (SELECT t, g, count(*) AS c FROM grams GROUP BY t, g),
sizes AS (SELECT t, sum(c) AS n FROM bags GROUP BY t),
pairs AS (SELECT a.t AS a, b.t AS b, sum(least(a.c, b.c)) AS shared FROM bags a JOIN bags b ON a.g = b.g AND a.t < b.t GROUP BY a.t, b.t),
links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.t JOIN sizes y ON b = y.t WHERE shared >= 0.8 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT t AS a, t AS b FROM texts UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
classes AS (SELECT r.a AS t, min(x.least) AS class_id FROM reach r JOIN texts x ON r.b = x.t GROUP BY r.a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(x.copies, 1) AS copies
FROM docs d LEFT JOIN texts x ON len(d.words) > 0 AND d.text = x.text LEFT JOIN classes c ON x.t = c.t
"""
