"""Order-dependent splitting and packing of texts."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the texts that are split before their pieces are handed on.
PIECE_CHARACTERS = 1_000_000


def utf16_units(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


def line_chunks(text: str, most: int) -> list[str]:
    """TXT-04: pieces of at most `most` UTF-16 units, at line ends if they can be; never none."""
    pieces: list[str] = []
    for n, line in enumerate(text.split("\n")):
        parts, size = [[]], 0
        for ch in line:
            units = 2 if ch > "￿" else 1
            if size + units > most:
                parts.append([])
                size = 0
            parts[-1].append(ch)
            size += units
        parts = ["".join(p) for p in parts]
        for k, part in enumerate(parts):
            if (n or k) and utf16_units(pieces[-1]) + 1 + utf16_units(part) <= most:
                pieces[-1] += "\n" + part
            else:
                pieces.append(part)
    return pieces


def piece_bounds(text: str, size: int, back: int) -> list[tuple[int, int]]:
    """Where pieces of at most `size` characters lie, each beginning `back` characters before the end of the last.

    A piece ends at the last paragraph break of its second half, else at the last sentence
    break there, else where it is full; pieces begin at a word.
    """
    breaks = [[m.start() for m in re.finditer(f"(?={mark})", text)] for mark in ("\n\n", r"\. ")]
    words = [m.start() for m in re.finditer(r"\S", text)]
    bounds = [(0, len(text))]
    while bounds[-1][1] - bounds[-1][0] > size:
        start, _ = bounds.pop()
        ends = (marks[bisect.bisect_right(marks, start + size - 2) - 1] for marks in breaks if marks and marks[0] <= start + size - 2)
        end = next((e for e in ends if e >= start + size // 2), start + size)
        word = bisect.bisect_left(words, max(end - back, start + 1))
        bounds += [(start, end), (words[word] if word < len(words) else len(text), len(text))]
    return bounds


def overlapping_pieces(text: str, tokens: int, overlap: int = 200) -> list[str]:
    """TXT-11: pieces of at most tokens (three characters each) that overlap, by a quarter of a piece at most."""
    size = tokens * 3
    if len(text) < size + 3:  # no more tokens than asked for, rounded down
        return [text]
    bounds = piece_bounds(text, size, min(overlap, size // 4))
    pieces = [text[a:b].rstrip() if b < len(text) else text[a:b] for a, b in bounds]
    return [p for p in pieces if p] or [text]


def split_rows(rows: DataFrame, id_col: str, text_col: str, split: Callable[[str], Sequence[str]]) -> DataFrame:
    """TXT-04, TXT-05, TXT-11: (id, piece, pieces, text): each text's pieces, numbered from 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A batch of texts may have tens of MB: some texts at a time become strings, and their pieces leave before the next.
        for batch in batches:
            ids, texts, start = batch.column(0), batch.column(1), 0
            while start < batch.num_rows:
                at, size, out = start, 0, []
                while at < batch.num_rows and size < PIECE_CHARACTERS:
                    text = texts[at].as_py()
                    if text is not None:
                        parts = [*split(text)]
                        size += len(text)
                        out += [(at, len(parts), k, p) for k, p in enumerate(parts)]
                    at += 1
                rows, pieces, piece, text = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, "int64")), pa.array(pieces, "int32"), pa.array(piece, "int32"), pa.array(text, "string")], ["id", "pieces", "piece", "text"])
                start = at

    kind = dict(rows.dtypes)[id_col]
    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, f"id {kind}, pieces int, piece int, text string")


def pack(rows: DataFrame, key: str, order: Sequence[str], size_col: str, budget: int, most: int | None = None) -> DataFrame:
    """TXT-12, TXT-24, SNK-23: rows with `part`: in order, a part is closed when the next row would exceed budget, or has `most` rows.

    A row beyond the budget alone is a part of its own. The fold carries two numbers, so
    a key's rows stream through one task, whatever their number.
    """
    fields = [f for f in rows.schema.fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "part int"])

    def fold(batches):
        now, part, total, n = object(), 0, 0, 0
        for pdf in batches:
            out = []
            for k, size in zip(pdf[key], pdf[size_col], strict=True):
                if k != now:
                    now, part, total, n = k, 0, 0, 0
                elif n and (total + size > budget or most is not None and n >= most or total > budget):
                    part, total, n = part + 1, 0, 0
                out.append(part)
                total, n = total + size, n + 1
            yield pdf.assign(part=pd.Series(out, index=pdf.index, dtype="int32"))

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, schema)
