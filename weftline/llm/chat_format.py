"""Chat formatting by columnar byte assembly, and the way back.

A conversation is ``<s>`` and then, for each turn, ``[INST]`` role ``[/INST]`` text ``</s>``.
In roles and texts a backslash is doubled and one is put after the first character of each control
string, so the output's control strings are the template's own and the texts come back exactly.

For a batch, segment lengths, cumulative offsets and scatter indices are computed in numpy, and all
headers and contents are copied into one preallocated Arrow buffer. A conversation of more than
``PART_BYTES`` becomes several consecutive parts, so no task ever holds all of one.

Defined cases: a null text or role is empty; turns that tie go by role, then text; rows with a
null conversation id form one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.columnar import bytes_and_offsets, keep_arenas, plain_strings, ragged_index

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
LEARNED_ROLE = "assistant"
PART_BYTES = 8 << 20
#: Bytes above which a segment is copied as one block, without an index for each byte.
LONG_SEGMENT = 512

_TURN = re.compile(re.escape(OPEN) + r"(.*?)" + re.escape(CLOSE) + r"(.*?)" + re.escape(END), re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(texts, "\\", "\\\\")
    for control in (BEGIN, OPEN, CLOSE, END):
        texts = pc.replace_substring(texts, control, control[0] + "\\" + control[1:])
    return texts


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _put(out: np.ndarray, at: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """Copy the segments ``data[starts[i] : starts[i] + lengths[i]]`` to ``out[at[i] :]``: short ones by scatter indices, long ones whole."""
    short = np.flatnonzero(lengths <= LONG_SEGMENT)
    out[ragged_index(at[short], lengths[short])] = data[ragged_index(starts[short], lengths[short])]
    for i in np.flatnonzero(lengths > LONG_SEGMENT).tolist():
        out[at[i] : at[i] + lengths[i]] = data[starts[i] : starts[i] + lengths[i]]


def _assemble(table: pa.Table, first: np.ndarray, begins: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Formatted conversations and their loss spans (code points). first: turns that open a conversation; begins: those that open an output row."""
    n = table.num_rows
    roles = plain_strings(table["role"])
    codes = roles.dictionary_encode()
    heads = [f"{b}{OPEN}{r}{CLOSE}".encode() for r in escape(codes.dictionary).to_pylist() for b in ("", BEGIN)]
    head_cuts = np.concatenate([[0], np.cumsum([len(h) for h in heads])])
    contents, cuts = bytes_and_offsets(escape(plain_strings(table["text"])))
    head = 2 * codes.indices.to_numpy() + first
    lengths = np.stack([np.diff(head_cuts)[head], np.diff(cuts), np.full(n, len(END))], 1)
    ends = np.cumsum(lengths.ravel()).reshape(n, 3)
    places = ends - lengths
    # Everything is copied once, to its place in the buffer that the output array then owns.
    buffer = pa.allocate_buffer(int(ends[-1, 2]))
    out = np.frombuffer(buffer, np.uint8)
    _put(out, places[:, 0], np.frombuffer(b"".join(heads), np.uint8), head_cuts[head], lengths[:, 0])
    _put(out, places[:, 1], contents, cuts[:-1], lengths[:, 1])
    out[places[:, 2, None] + np.arange(len(END))] = np.frombuffer(END.encode(), np.uint8)
    at = np.flatnonzero(begins)
    row_cuts = np.append(places[at, 0], len(out))
    formatted = pa.StringArray.from_buffers(len(at), pa.py_buffer(row_cuts.astype(np.int32)), buffer)
    # Loss spans count code points from the row's start.
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80, dtype=np.int32)])
    learned = np.flatnonzero(np.asarray(pc.equal(roles, LEARNED_ROLE)))
    row = np.searchsorted(at, learned, "right") - 1
    base = points[row_cuts[row]]
    low = points[places[learned, 1]] - base
    high = points[ends[learned, 1]] - base
    spans = np.searchsorted(row, np.arange(len(at) + 1)).astype(np.int32)
    as_list = lambda x: pa.ListArray.from_arrays(pa.array(spans), pa.array(x.astype(np.int32)))
    return formatted, as_list(low), as_list(high)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation (or part): conv_id, part, formatted, loss_starts, loss_ends (code points). Parts follow one another."""
    picked = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    id_type = picked.schema["conv_id"].dataType.simpleString()
    ordered = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_arenas()
        held: list[pa.RecordBatch] = []
        cut_off: tuple | None = None  # the conversation that was cut off last, and its next part

        def emit(table: pa.Table) -> pa.RecordBatch:
            ids = table["conv_id"].combine_chunks()
            begins = _changes(ids)
            part = cut_off[1] if cut_off and cut_off[0] == ids[0].as_py() else 0
            first = begins.copy()
            first[0] = part == 0
            formatted, low, high = _assemble(table, first.astype(np.int64), begins)
            parts = np.zeros(len(formatted), np.int32)
            parts[0] = part
            return pa.RecordBatch.from_arrays([ids.filter(pa.array(begins)), pa.array(parts), formatted, low, high], names=["conv_id", "part", "formatted", "loss_starts", "loss_ends"])

        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                held.append(batch.slice(i, 2000))
                table = pa.Table.from_batches(held)
                last = int(np.flatnonzero(_changes(table["conv_id"].combine_chunks()))[-1])
                if last:
                    yield emit(table.slice(0, last))
                    cut_off, table = None if cut_off and cut_off[0] != table["conv_id"][last].as_py() else cut_off, table.slice(last)
                if table.nbytes > PART_BYTES:
                    row = emit(table)
                    yield row
                    cut_off, table = (row.column(0)[-1].as_py(), row.column(1)[-1].as_py() + 1), table.slice(table.num_rows)
                held = table.to_batches()
        if held:
            yield emit(pa.Table.from_batches(held))

    return ordered.mapInArrow(run, f"conv_id {id_type}, part int, formatted string, loss_starts array<int>, loss_ends array<int>")


def _changes(ids: pa.Array) -> np.ndarray:
    """True where an id, null counting as one, differs from the one before; always at 0."""
    coded = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate([[True], coded[1:] != coded[:-1]])


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of each conversation as its formatted parts and loss spans give it back.

    Reads the parts in the order in which ``format_chats`` emits them, one after another in a task.
    """
    id_type = chats.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list = []
        done: list[tuple] = []

        def close() -> None:
            if open_:
                conv, n, turns, chars, loss, size = open_
                done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                open_.clear()

        for batch in batches:
            for conv, part, text, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not part:
                    close()
                    open_[:] = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    open_[1] += 1
                    open_[2].update(f"{role}\n{said}\n".encode())
                for a, b in zip(low, high, strict=True):
                    learned = unescape(text[a:b])
                    open_[3] += len(learned)
                    open_[4].update(learned.encode())
                open_[5] += len(text)
            if len(done) > 2000:
                yield _rows(done, batch.schema.field(0).type)
                done = []
        close()
        if done:
            yield _rows(done, batch.schema.field(0).type)

    return chats.mapInArrow(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


#: The digests in DuckDB SQL, over the view ``conversations``.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
marked AS (
  SELECT *, length(role) + length(text) AS plain,
    length(role) - length(replace(role, '\', '')) + length(text) - length(replace(text, '\', ''))
    + (length(role) + length(text) - length(replace(role, '<s>', '')) - length(replace(text, '<s>', ''))) // 3
    + (length(role) + length(text) - length(replace(role, '</s>', '')) - length(replace(text, '</s>', ''))) // 4
    + (length(role) + length(text) - length(replace(role, '[INST]', '')) - length(replace(text, '[INST]', ''))) // 6
    + (length(role) + length(text) - length(replace(role, '[/INST]', '')) - length(replace(text, '[/INST]', ''))) // 7 AS escapes
  FROM turns
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(plain + escapes + 17))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
