"""Conversations as training text with a loss mask, assembled as columns of bytes.

A turn becomes ``### role: text</turn>`` and a line end. Inside role and text a backslash goes
before every backslash, ``#`` and ``<`` (in a role before ``:`` too), so a text can hold no control
string and the original comes back exactly. For a batch, numpy computes the length of each
segment, cumulative offsets and scatter indices, and fills one preallocated buffer that
Arrow then takes as it is.

A conversation of very many turns is cut into segments of TURNS_A_SEGMENT turn numbers,
which are formatted apart from each other: no task needs all of a hot conversation's text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.llm.common import Scratch, read

OPEN, AFTER_ROLE, CLOSE = b"### ", b": ", b"</turn>\n"
TURNS_A_SEGMENT = 256
#: Text that one segment may gather before it is written as several parts.
PART_BYTES = 16 << 20
TEST_CONVERSATION = -7
TEST_TEXT = r"\### Assistant: </turn> ok"

_TURN = re.compile(rb"### ((?:[^\\:#<]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(rb"\\(.)", re.DOTALL)


def _bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets from 0) of a string array; null is empty."""
    array = array.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _escape(data: np.ndarray, offsets: np.ndarray, special: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Data with a backslash before each special byte, and the offsets that follow."""
    mark = np.zeros(256, bool)
    mark[list(special)] = True
    hit = mark[data]
    before = np.concatenate(([0], np.cumsum(hit)))
    out = np.full(len(data) + before[-1], ord("\\"), np.uint8)
    out[np.arange(len(data)) + before[1:]] = data
    return out, offsets + before[offsets]


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offset of each turn and the end, start and end of each text in bytes)."""
    roles, role_at = _escape(*_bytes_of(role), b"\\#<:")
    texts, text_at = _escape(*_bytes_of(text), b"\\#<")
    n = len(role)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(OPEN), len(AFTER_ROLE), len(CLOSE)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5) if n else np.zeros((0, 5), np.int64)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for column, constant in ((0, OPEN), (2, AFTER_ROLE), (4, CLOSE)):
        out[starts[:, column, None] + np.arange(len(constant))] = np.frombuffer(constant, np.uint8)
    for column, data, at in ((1, roles, role_at), (3, texts, text_at)):
        out[np.arange(len(data)) + np.repeat(starts[:, column] - at[:-1], np.diff(at))] = data
    return out, np.concatenate((starts[:, 0], [len(out)])), starts[:, 3], ends[:, 3]


def _segments(table: pa.Table, key: pa.DataType, part: int) -> Iterator[pa.RecordBatch]:
    """Formats a table whose rows are in order; each run of (conv_id, block) becomes one row."""
    table = table.combine_chunks()
    role, text = (table.column(c).combine_chunks() if table.num_rows else pa.array([], pa.string()) for c in ("role", "text"))
    out, turn_at, text_start, text_end = assemble(role, text)
    first = _run_starts(table)
    bounds = np.append(first, table.num_rows)
    points = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
    run = np.repeat(np.arange(len(first)), np.diff(bounds))
    base = points[turn_at[first]][run]
    masked = np.asarray(pc.fill_null(pc.equal(role, "assistant"), False))
    counts = np.concatenate(([0], np.cumsum(np.add.reduceat(masked, first) if len(first) else [])))
    lists = lambda v: pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(v[masked], pa.int64()))
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(turn_at[bounds].astype(np.int64)), pa.py_buffer(out)])
    take = pa.array(first)
    yield pa.RecordBatch.from_arrays(
        [table.column("conv_id").take(take).combine_chunks().cast(key), table.column("_block").take(take).combine_chunks(), pa.array(np.r_[part, np.zeros(len(first) - 1, np.int64)], pa.int32()), pa.array(np.diff(bounds), pa.int64()), formatted.cast(pa.string()), lists(points[text_start] - base), lists(points[text_end] - base)],
        names=["conv_id", "block", "part", "n_turns", "formatted", "loss_starts", "loss_ends"],
    )


def _run_starts(table: pa.Table) -> np.ndarray:
    """Indices where (conv_id, _block) changes."""
    change = np.zeros(table.num_rows, bool)
    if len(change):
        change[0] = True
    for c in ("conv_id", "_block"):
        codes = np.asarray(table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices)
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change)


def _key(table: pa.Table, row: int) -> tuple:
    return table.column("conv_id")[row].as_py(), table.column("_block")[row].as_py()


def format_conversations(conversations: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """conv_id, block, part, n_turns, formatted, loss_starts, loss_ends: segments of conversations.

    Turns are in the order of turn, ties by role and text. A conversation's segments follow each
    other by (block, part); most have one. loss_starts and loss_ends are code-point ranges
    of the assistant's (escaped) texts in ``formatted``. A null text or role is an empty one; rows with
    a null conv_id form one conversation, null turns come first; repeated rows are turns like
    any other; further columns are ignored. An empty input gives no segments.
    """
    key = conversations.schema["conv_id"].dataType.simpleString()
    block = F.floor(F.col("turn") / TURNS_A_SEGMENT).cast("long").alias("_block")
    rows = conversations.select("conv_id", block, "turn", "role", "text").repartition("conv_id", "_block").sortWithinPartitions("conv_id", "_block", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind, part, going = None, None, 0, None  # going: key of a run of which parts are out
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kind = batch.schema.field("conv_id").type
            if held is not None:
                table = pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            if going != _key(table, 0):
                part, going = 0, None
            cut = int(_run_starts(table)[-1])
            held = table.slice(cut)
            if cut:
                yield from _segments(table.slice(0, cut), kind, part)
                part, going = 0, None
            if held.nbytes > part_bytes:
                yield from _segments(held, kind, part)
                part, going, held = part + 1, _key(held, 0), None
        if held is not None and held.num_rows:
            yield from _segments(held, kind, part if going == _key(held, 0) else 0)

    schema = f"conv_id {key}, block long, part int, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"
    return rows.select("conv_id", "_block", "role", "text").mapInArrow(run, schema)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a segment."""
    data, out, at = formatted.encode(), [], 0
    for m in _TURN.finditer(data):
        if m.start() != at:
            raise ValueError(f"not a turn at byte {at}")
        at = m.end()
        out.append((_ESCAPED.sub(rb"\1", m[1]).decode(), _ESCAPED.sub(rb"\1", m[2]).decode()))
    if at != len(data):
        raise ValueError(f"not a turn at byte {at}")
    return out


def summarize(segments: DataFrame) -> DataFrame:
    """Per conversation, read back from its segments: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Segments stream through in order; a digest is fed as they come and holds no text.
    """
    key = segments.schema["conv_id"].dataType.simpleString()
    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part").select("conv_id", "formatted", "loss_starts", "loss_ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, kind = None, None

        def row(s):
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]), (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for conv, formatted, starts, ends in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for a, b in zip(starts, ends):
                    text = re.sub(r"\\(.)", r"\1", formatted[a:b], flags=re.DOTALL)
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(formatted)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if state is not None:
            yield row(state)

    return rows.mapInArrow(run, f"conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the test conversation, written, and read back."""
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    test = spark.createDataFrame([(TEST_CONVERSATION, i, role, TEST_TEXT) for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    test = test.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])
    return summarize(Scratch(spark, "op5").keep(format_conversations(rows.unionByName(test)), "formatted"))


_ESC = r"regexp_replace({c}, '([\\#<])', '\\\1', 'g')"
ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{TEST_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{TEST_TEXT}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(14 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length({_ESC.format(c="text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
