"""Chat template by columnar byte assembly, and the way back from its output.

A turn is written as a head line that names the role, the text, and an end line:

    <turn role="user">
    text
    </turn>

A control string (``<turn`` or ``</turn``) inside a text gets one backslash before it, whatever stands
before that, and loses just one when read, so texts come back as they were; a control string without
a backslash is always the template's own. A batch of turns is written in one go: segment lengths give
cumulative offsets, these give scatter indices, and heads, contents and ends are copied into one
preallocated buffer that becomes the Arrow column. The loss mask holds the code points of the
assistant's texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

CONTROL = re.compile(rb"</?turn")
END = np.frombuffer(b"\n</turn>\n", np.uint8)
TURN = re.compile(r'<turn role="([^"]*)">\n(.*?)\n</turn>\n', re.DOTALL)
ESCAPED = re.compile(r"\\(</?turn)")
#: Bytes of text for which scatter indices are held at a time.
STEP = 4 << 20
#: Bytes that a column of a batch can hold.
MOST = (1 << 31) - 1

MASK = "array<struct<start: int, end: int>>"
MASK_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
TURNS = "struct<turns: array<struct<role: string, text: string>>, loss: string>"
TURNS_ARROW = pa.struct(
    [("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("loss", pa.string())]
)


def head_of(role: str) -> bytes:
    return f'<turn role="{quote(role, safe="")}">\n'.encode()


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _escapes(content: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where control strings begin; one that two texts make up between them is none."""
    found = np.array([(m.start(), m.end()) for m in CONTROL.finditer(memoryview(content))], np.int64).reshape(-1, 2)
    row = np.searchsorted(starts, found[:, 0], "right")
    return found[found[:, 1] <= starts[row], 0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All turns as one buffer; where each turn starts in it (and the end); where each content starts and ends."""
    roles, texts = pc.fill_null(roles, "").dictionary_encode(), pc.fill_null(texts, "")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    content = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8)
    starts = at - at[0]
    heads = [np.frombuffer(head_of(r), np.uint8) for r in roles.dictionary.to_pylist()]
    role = roles.indices.to_numpy()

    escapes = _escapes(content, starts)
    head_size = np.array([len(h) for h in heads], np.int64)[role]
    inside = np.diff(starts) + np.diff(np.searchsorted(escapes, starts))
    turn = _starts(head_size + inside + len(END))
    begin, end = turn[:-1] + head_size, turn[:-1] + head_size + inside

    out = np.empty(turn[-1], np.uint8)
    for k, head in enumerate(heads):
        rows = np.flatnonzero(role == k)
        out[turn[rows][:, None] + np.arange(len(head))] = head
    out[end[:, None] + np.arange(len(END))] = END
    first = 0
    while first < len(begin):  # as many texts at a time as STEP allows, one at least
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + STEP, "right")) - 1)
        a, b = starts[first], starts[last]
        own = escapes[np.searchsorted(escapes, a) : np.searchsorted(escapes, b)]
        if last == first + 1 and not len(own):
            out[begin[first] : end[first]] = content[a:b]
        else:
            to = np.repeat(begin[first:last] - starts[first:last], np.diff(starts[first : last + 1])) + np.arange(a, b)
            if len(own):
                before = np.zeros(b - a, np.int64)
                before[own - a] = 1
                total = _starts(before)
                to += total[1:] - np.repeat(total[starts[first:last] - a], np.diff(starts[first : last + 1]))
                out[to[own - a] - 1] = ord("\\")
            out[to] = content[a:b]
        first = last
    return out, turn, np.stack([begin, end], 1)


def _format(batch: pa.Table, learnt: str) -> pa.RecordBatch:
    """Rows of whole conversations, in order: a row for each conversation."""
    conv = batch["conv"].combine_chunks()
    same = pc.or_kleene(
        pc.fill_null(pc.equal(conv[1:], conv[:-1]), False), pc.and_(pc.is_null(conv[1:]), pc.is_null(conv[:-1]))
    )
    first = np.concatenate([[0], np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1])
    out, turn, inside = assemble(batch["role"].combine_chunks(), batch["text"].combine_chunks())
    if turn[-1] > MOST:
        raise ValueError(f"the conversations of a batch come to {turn[-1]} bytes, which one column can't hold")
    ends = np.append(first, batch.num_rows)
    letters = _starts((out & 0xC0) != 0x80)
    rows = np.flatnonzero(pc.fill_null(pc.equal(batch["role"], learnt), False).to_numpy())
    spans = letters[inside[rows]] - letters[turn[first[np.searchsorted(first, rows, "right") - 1]]][:, None]
    mask = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(rows, ends), pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(spans[:, 0], pa.int32()), pa.array(spans[:, 1], pa.int32())], names=["start", "end"]
        ),
    )
    offsets = pa.py_buffer(turn[ends].astype(np.int32))
    formatted = pa.StringArray.from_buffers(len(first), offsets, pa.py_buffer(out))
    return pa.RecordBatch.from_arrays([conv.take(pa.array(first)), formatted, mask], ["conv", "formatted", "mask"])


def _last_break(conv: pa.ChunkedArray) -> int:
    """Row at which the last conversation of the batch begins."""
    last, at = conv[len(conv) - 1], len(conv) - 1
    while at and conv[at - 1] == last:
        at -= 1
    return at


def format_chats(
    turns: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    learnt: str = "assistant",
) -> DataFrame:
    """A row per conversation: its id, ``formatted`` and ``mask``, the code points of the learnt role's texts.

    Turns stand in the order of their number, nulls first; equal numbers by role and text. A null
    text or role is empty; a null id is one conversation. Repeated rows are turns like any other. Further
    columns are left out. A conversation's text is one value, so its turns meet in one task; that is the
    largest unit held. An empty table gives an empty one.
    """
    rows = turns.select(
        F.col(f"`{conv_column}`").alias("conv"),
        F.col(f"`{turn_column}`").alias("turn"),
        F.col(f"`{role_column}`").alias("role"),
        F.col(f"`{text_column}`").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[pa.RecordBatch] = []  # of the conversation that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = _last_break(batch["conv"])
            goes_on = open_rows and open_rows[0]["conv"][0] == batch["conv"][0]
            if not (goes_on and cut == 0):
                whole = pa.Table.from_batches([*open_rows, batch.slice(0, cut)])
                if whole.num_rows:
                    yield _format(whole, learnt)
                open_rows = []
            open_rows.append(batch.slice(cut))
        if open_rows:
            yield _format(pa.Table.from_batches(open_rows), learnt)

    kind = rows.schema["conv"].dataType.simpleString()
    return (
        rows.repartition("conv")
        .sortWithinPartitions("conv", "turn", "role", "text")
        .select("conv", "role", "text")
        .mapInArrow(run, f"conv {kind}, formatted string, mask {MASK}")
        .withColumnRenamed("conv", conv_column)
    )


def read_chat(formatted: str, mask: list[dict]) -> dict:
    """Turns and the learnt text, unescaped; nothing but the template's own output may be given."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append({"role": unquote(m[1]), "text": ESCAPED.sub(r"\1", m[2])})
        at = m.end()
    loss = "".join(ESCAPED.sub(r"\1", formatted[s["start"] : s["end"]]) for s in mask)
    return {"turns": turns, "loss": loss}


def read_chats(formatted: Column, mask: Column) -> Column:
    """``turns`` and ``loss`` (all text under the mask, unescaped) read back from formatted conversations."""

    @F.arrow_udf(TURNS)
    def run(formatted: pa.Array, mask: pa.Array) -> pa.Array:
        rows = (read_chat(f.as_py() or "", m.as_py() or []) for f, m in zip(formatted, mask, strict=True))
        return pa.array(rows, TURNS_ARROW)

    return run(formatted, mask)
