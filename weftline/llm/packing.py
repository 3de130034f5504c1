"""Packing of documents into fixed token windows by best-fit decreasing.

Documents are tokenised where they lie and cut into pieces: full windows first, then the
rest. Only 16-byte descriptors of the pieces are shuffled for the packing itself, dealt
evenly over shards of bounded size; in a shard, a segment tree indexed by remaining
capacity finds the tightest open window for each piece, longest piece first. The ids then
join their place.

Defined cases: a null text is an empty one and yields the end id alone; repeated rows and
null document ids are documents of their own; an empty table packs to no rows. Columns
other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.columnar import keep_arenas, plain_strings, ragged_index, slices
from weftline.llm.word_bpe import word_bpe
from weftline.scratch import materialize

#: Pieces that one packing task takes; memory and time of a task stay bounded by it.
SHARD_PIECES = 50_000


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that counts them."""

    def __init__(self, window: int):
        self.size = 1
        while self.size <= window:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window_id: int) -> None:
        self.stacks[capacity].append(window_id)
        node = capacity + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window of least capacity that is at least ``need``, removed; None if there is none."""
        count, node = self.count, need + self.size
        if not count[node]:
            # Up until a right sibling holds a window, then down its leftmost path.
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                if not count[node]:
                    node += 1
        capacity = node - self.size
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, self.stacks[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece. Ties go to the earlier piece."""
    order = np.argsort(-lengths, kind="stable")
    place, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_, made = OpenWindows(window), 0
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        found = open_.take(length)
        if found is None:
            found = window, made
            made += 1
        capacity, number = found
        place[i], offset[i] = number, window - capacity
        if capacity > length:
            open_.add(capacity - length, number)
    return place, offset


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the documents' ids: piece_uid, doc_id, start, length, doc_tokens, ids (little-endian uint32)."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = picked.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_arenas()
        model = word_bpe(tokenizer_path)
        uid = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text"):
            ids, bounds = model.encode(plain_strings(batch.column(1)))
            n = batch.num_rows
            # The end id after each document's own ids.
            flat = np.insert(ids, bounds[1:], end_id).astype("<u4")
            bounds = bounds + np.arange(n + 1)
            total = np.diff(bounds)
            pieces = -(-total // window)
            owner = np.repeat(np.arange(n), pieces)
            start = ragged_index(np.zeros(n), pieces) * window
            length = np.minimum(window, total[owner] - start)
            cuts = np.append(bounds[owner] + start, bounds[-1]) * 4
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uid + np.arange(len(owner))),
                    batch.column(0).take(pa.array(owner)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(total[owner]),
                    pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(flat)]),
                ],
                names=["piece_uid", "doc_id", "start", "length", "doc_tokens", "ids"],
            )
            uid += len(owner)

    return picked.mapInArrow(cut, f"piece_uid long, doc_id {id_type}, start long, length long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", tag: str = "") -> DataFrame:
    """Pack all documents into windows of ``window`` ids.

    Returns one row a piece: piece_uid, doc_id, start, length, doc_tokens, ids, sequence_id, offset.
    In a sequence the pieces lie gapless from offset 0.
    """
    pieces = materialize(token_pieces(docs, tokenizer_path, window, end_id, id_col, text_col), "pieces", tag)
    partial = pieces.where(F.col("length") < window).select("piece_uid", "length")
    shards = max(1, -(-partial.count() // SHARD_PIECES))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece_uid")
        number, offset = best_fit_decreasing(table["length"].to_numpy(), window)
        shard = table["shard"][0].as_py() if table.num_rows else 0
        return pa.table({"piece_uid": table["piece_uid"], "sequence_id": ((shard << 33) + number) * 2, "offset": offset})

    placed = (
        partial.withColumn("shard", F.pmod(F.xxhash64("piece_uid"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(place, "piece_uid long, sequence_id long, offset long")
    )
    # The descriptors are the small side: hashing them spares a sort of all ids.
    joined = pieces.join(placed.hint("shuffle_hash"), "piece_uid", "left")
    return joined.withColumn("sequence_id", F.coalesce("sequence_id", F.col("piece_uid") * 2 + 1)).withColumn("offset", F.coalesce("offset", F.lit(0).cast("long")))


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed windows themselves: sequence_id, ids (uint32 bytes, pieces in order), doc_ids, n_tokens."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(ordered.alias("parts"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("parts.ids", F.lit(b""), lambda a, x: F.concat(a, x))
    return grouped.select("sequence_id", joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"), "n_tokens")
