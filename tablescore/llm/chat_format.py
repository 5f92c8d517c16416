"""Chat formatting by columnar byte assembly.

A conversation's rows, in order of turn, become one marked-up text:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n        for each turn

A control string inside a text is made harmless by one backslash between `<` and `|` (one more
where backslashes stand there already), so `<|` never occurs in an escaped text and taking one
backslash away restores it. A role's backslashes and line ends are escaped too.

A batch of rows is assembled at once: segment lengths, cumulative offsets and scatter indices are
numpy arrays, and headers and contents are copied into one preallocated buffer that becomes the
Arrow string column as it is. A conversation that spans batches or range partitions comes out in
several parts of whole turns, so memory is bounded by a batch however long a conversation is.

Defined cases: null role or text is empty; null conversation ids are one conversation; rows with
equal turns follow by role, then text (nulls first); repeated rows are turns of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import string_bytes

# The marks of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\\\1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(column: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copies segment i of data to out[at[i]:]."""
    length = np.diff(offsets)
    out[np.repeat(at - offsets[:-1], length) + np.arange(offsets[-1])] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all rows; where rows begin (n + 1); where their contents begin and end (n x 2)."""
    head, tail = (np.frombuffer(x.encode(), np.uint8) for x in (OPEN, CLOSE))
    role, role_at = string_bytes(escape_role(roles))
    text, text_at = string_bytes(escape(texts))
    n_role, n_text = np.diff(role_at), np.diff(text_at)
    rows = np.concatenate([[0], np.cumsum(len(head) + n_role + 1 + n_text + len(tail))])
    out = np.empty(rows[-1], np.uint8)
    out[rows[:-1, None] + np.arange(len(head))] = head
    role_to = rows[:-1] + len(head)
    _scatter(out, role_to, role, role_at)
    content = role_to + n_role + 1
    out[content - 1] = 10
    _scatter(out, content, text, text_at)
    out[(content + n_text)[:, None] + np.arange(len(tail))] = tail
    return out, rows, np.stack([content, content + n_text], 1)


def format_conversations(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """Rows (conversation, seq, formatted, loss): a conversation's parts in order of seq. loss lists the
    byte spans [begin, end) of `formatted` that hold texts of the role `learn`, still escaped."""
    rows = turns.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    order = ["conv", "turn", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            out, at, content = assemble(batch["role"], batch["text"])
            conv = batch["conv"]
            same = pc.fill_null(pc.equal(conv[1:], conv[:-1]), False).to_numpy(zero_copy_only=False) | (pc.is_null(conv[1:]).to_numpy(zero_copy_only=False) & pc.is_null(conv[:-1]).to_numpy(zero_copy_only=False))
            first = np.concatenate([[0], np.flatnonzero(~same) + 1])
            row_at, place = at[np.append(first, batch.num_rows)], np.repeat(np.arange(len(first)), np.diff(np.append(first, batch.num_rows)))
            text_col = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(row_at.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
            mine = np.flatnonzero(pc.equal(batch["role"], learn).to_numpy(zero_copy_only=False))
            spans = (content[mine] - row_at[place[mine], None]).astype(np.int64)
            lists = np.searchsorted(place[mine], np.arange(len(first) + 1)).astype(np.int32)
            span = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["begin", "end"])
            yield pa.RecordBatch.from_arrays([conv.take(pa.array(first)), pa.array(seq + np.arange(len(first))), text_col, pa.ListArray.from_arrays(pa.array(lists), span)], [conversation, "seq", "formatted", "loss"])
            seq += len(first)

    kind = rows.schema["conv"].dataType.simpleString()
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return spread.mapInArrow(run, f"`{conversation}` {kind}, seq long, formatted string, loss array<struct<begin: long, end: long>>")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted part."""
    return [(unescape_role(role), unescape(text)) for role, _, text in (turn[len(OPEN) :].partition("\n") for turn in formatted.split(CLOSE)[:-1])]


def conversation_digests(parts: DataFrame, *, conversation: str = "conv_id") -> DataFrame:
    """What the formatted parts hold, read back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars
    for each conversation. Parts stream through in order; no conversation is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def done() -> pa.RecordBatch:
            conv, n, turns, chars, loss, size = state
            columns = [[conv], [n], [turns.hexdigest()], [chars], [loss.hexdigest()], [size]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

        out = None
        for batch in batches:
            out = out or pa.schema([(conversation, batch.schema.field(conversation).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            for conv, text, spans in zip(batch[conversation].to_pylist(), batch["formatted"].to_pylist(), batch["loss"].to_pylist(), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        yield done()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                raw = text.encode()
                for span in spans:
                    said = unescape(raw[span["begin"] : span["end"]].decode())
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
        if state is not None:
            yield done()

    kind = parts.schema[conversation].dataType.simpleString()
    spread = parts.repartition(conversation).sortWithinPartitions(conversation, "seq")
    return spread.mapInArrow(run, f"`{conversation}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
