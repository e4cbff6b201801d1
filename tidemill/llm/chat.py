"""Chat formatting by token-level assembly."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens

START, END = "<|im_start|>", "<|im_end|>"
#: Reserved ids, beyond the vocabulary: no text can encode to them.
START_ID, END_ID = 50_300, 50_301

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """Text in which no control string can be read: <| becomes <\\|, <\\| becomes <\\\\|, and so on."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line: escaped as text, and line ends and backslashes written out."""
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


CHUNK_COLUMNS = ["conv_id", "chunk", "last", "formatted", "input_ids", "loss_mask"]
CHUNK_SCHEMA = "conv_id {id}, chunk int, last boolean, formatted string, input_ids array<int>, loss_mask array<tinyint>"


def format_conversations(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained_role: str = "assistant",
    vocabulary: str | None = None,
    chunk_tokens: int = 65_536,
) -> DataFrame:
    """Conversations as token ids, loss masks and template text.

    A turn reads ``<|im_start|>role\\ntext<|im_end|>\\n``. Role and text are encoded
    each for itself, and the reserved ids are put between them, so no content can
    give a control token. The mask is a running sum of +1 where a trained text
    begins and -1 where it ends. Control strings inside contents are escaped
    reversibly.

    Returns rows (conv_id, chunk, last, formatted, input_ids, loss_mask). A
    conversation is one row, unless it exceeds chunk_tokens: then it continues over
    chunks 0, 1, ... of whole turns, sorted within one partition, so memory does
    not grow with a conversation's length. Turns go by turn, role, text (nulls
    first); repeated rows are turns of their own. Null text or role is empty. Rows
    with a null conv_id form one conversation. Other columns are ignored; an empty table gives none.
    """
    id_type = turns.schema[conv_col].dataType
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    schema = T._parse_datatype_string(CHUNK_SCHEMA.format(id=id_type.simpleString()))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = functools.partial(tokens.encode, path=vocabulary, ordinary=True)
        line_end = encode("\n")
        out: list[tuple] = []
        text: list[str] = []
        ids: list[int] = []
        marks: list[tuple[int, int]] = []
        current, chunk, open_ = None, 0, False

        def close(last: bool) -> None:
            steps = np.zeros(len(ids) + 1, np.int8)
            for lo, hi in marks:
                steps[lo] += 1
                steps[hi] -= 1
            out.append((current, chunk, last, "".join(text), np.array(ids, np.int32), np.cumsum(steps[:-1], dtype=np.int8)))
            text.clear(), ids.clear(), marks.clear()

        def emit() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * 6
            kinds = [pa_id, pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int8())]
            batch = pa.RecordBatch.from_arrays([pa.array([*c], k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)
            out.clear()
            return batch

        pa_id = pa.int64()
        for batch in batches:
            pa_id = batch.column(0).type
            for conv, role, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ and conv != current:
                    close(last=True)
                    chunk = 0
                elif open_ and len(ids) >= chunk_tokens:
                    close(last=False)
                    chunk += 1
                    if sum(len(row[4]) for row in out) > 8 * chunk_tokens:
                        yield emit()
                current, open_ = conv, True
                head, content = escape_role(role or ""), escape(body or "")
                text += [START, head, "\n", content, END, "\n"]
                ids += [START_ID, *encode(head + "\n")]
                inner = encode(content)
                if role == trained_role and inner:
                    marks.append((len(ids), len(ids) + len(inner)))
                ids += [*inner, END_ID, *line_end]
            if out:
                yield emit()
        if open_:
            close(last=True)
            yield emit()

    return rows.mapInArrow(assemble, schema)


def read_back(chunks: DataFrame, *, vocabulary: str | None = None) -> DataFrame:
    """What formatted conversations say, from their tokens alone.

    Takes the rows of format_conversations in any order. Returns conv_id,
    n_turns, turns_sha256 (role, line end, text, line end per turn), loss_chars and
    loss_sha256 (the text under the mask) and formatted_chars.
    """
    schema = T.StructType(
        [T.StructField("conv_id", chunks.schema["conv_id"].dataType)]
        + [T.StructField(n, t) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = tokens.encoder(vocabulary).decode
        turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for k in range(batch.num_rows):
                ids = batch.column("input_ids")[k].values.to_numpy()
                mask = batch.column("loss_mask")[k].values.to_numpy()
                starts, ends = np.flatnonzero(ids == START_ID), np.flatnonzero(ids == END_ID)
                for lo, hi in zip(starts, ends, strict=True):
                    role, _, body = decode(ids[lo + 1 : hi].tolist()).partition("\n")
                    turns.update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
                edges = np.flatnonzero(np.diff(mask, prepend=0, append=0))
                for lo, hi in edges.reshape(-1, 2):
                    said = unescape(decode(ids[lo:hi].tolist()))
                    loss.update(said.encode())
                    counts[1] += len(said)
                counts[0] += len(starts)
                counts[2] += len(batch.column("formatted")[k].as_py())
                if batch.column("last")[k].as_py():
                    row = (batch.column("conv_id")[k].as_py(), counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            kinds = [batch.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=schema.names)

    rows = chunks.select(*CHUNK_COLUMNS).repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return rows.mapInArrow(read, schema)
