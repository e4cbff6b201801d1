"""Packing documents into fixed-length sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .tokens import encode

#: Rows of one length that are numbered together in one task.
RANK_ROWS = 2_000


def token_pieces(docs: DataFrame, *, id_col: str, text_col: str, capacity: int, end_id: int, vocabulary: str | None, keep_ids: bool) -> DataFrame:
    """Each document's token ids, then end_id, cut into pieces of at most capacity.

    Only longer documents are cut; the first piece takes what is left over. Gives
    doc_id, piece, start, length, ids_crc32 and, if asked for, ids.
    """
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField("doc_id", id_type), *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())))]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or "", vocabulary), end_id], dtype="<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                for n, lo in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[lo : first if n == 0 else lo + capacity]
                    row.append(k)
                    piece.append(n)
                    start.append(lo)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        kept.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, T.StructType(fields))


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to room.

    A bitset holds the sums that can be reached; bit s of the set after a length
    is on if s is a sum of it and the lengths before. Lengths enter from the
    longest, so short ones stay for later bins, and the walk stops once room is met.
    """
    full = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left:
            take = min(size, left)
            steps.append((length, take, sums))
            sums |= (sums << (take * length)) & full
            left, size = left - take, size * 2
        if sums >> room & 1:
            break
    best, chosen = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + take
            best -= take * length
    return chosen


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (lengths and how many of each, number of such bins).

    Each step seeds a bin with the longest length left, fills it with the fullest
    combination, and repeats that bin while the counts allow, so the number of
    steps depends on the number of different lengths, never on that of pieces.
    """
    counts = {n: c for n, c in counts.items() if c > 0}
    bins = []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        chosen = fullest(counts, capacity - seed)
        counts[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(counts[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        bins.append((chosen, times))
    return bins


def slots(bins: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """Places as (length, first rank, number of ranks, first bin, offset)."""
    used: dict[int, int] = {}
    out, bin_ = [], 0
    for chosen, times in bins:
        at = 0
        for length in sorted(chosen, reverse=True):
            for _ in range(chosen[length]):
                out.append((length, used.get(length, 0), times, bin_, at))
                used[length] = used.get(length, 0) + times
                at += length
        bin_ += times
    return out


def pack_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    vocabulary: str | None = None,
    keep_ids: bool = True,
) -> DataFrame:
    """Where each piece of each document goes.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with
    keep_ids, the ids themselves. Only the histogram of lengths (at most capacity
    rows) reaches the driver, which plans the bins on it; pieces then find their
    place by their rank among those of equal length. Ranks are numbered in salted
    chunks of a length, as many as its count asks for, so that no task holds a common length whole.

    Null text is empty: end_id alone. An empty table gives no rows. Rows of equal
    id are packed each for itself; which of identical pieces takes which place is open. Other columns are ignored.
    """
    spark = docs.sparkSession
    cut = token_pieces(docs, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, vocabulary=vocabulary, keep_ids=keep_ids)
    # A piece's number in its scan spreads those that share a document id.
    pieces = materialize(cut.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id())))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = spark.createDataFrame(slots(plan_bins(counts, capacity)), "p_length long, first_rank long, ranks long, first_bin long, offset long")
    # At most `capacity` lengths, each with its own number of chunks.
    chunks = spark.createDataFrame([(n, -(-c // RANK_ROWS)) for n, c in counts.items()], "c_length long, chunks long")
    keyed = pieces.join(F.broadcast(chunks), F.col("length") == F.col("c_length")).withColumn("chunk", F.pmod("__salt", F.col("chunks"))).drop("c_length", "chunks")
    before = (
        keyed.groupBy("length", "chunk").count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("chunk")) - F.col("count"))
        .select(F.col("length").alias("b_length"), F.col("chunk").alias("b_chunk"), "before")
    )
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("length", "chunk").orderBy("__salt")) - 1)
    ranked = ranked.join(before, (F.col("length") == F.col("b_length")) & (F.col("chunk") == F.col("b_chunk"))).withColumn("rank", F.col("rank") + F.col("before"))
    inside = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("ranks"))
    # places has a row for each planned step and length, which the histogram bounds.
    return ranked.join(F.broadcast(places), inside).select(*[c for c in pieces.columns if c != "__salt"], (F.col("first_bin") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")
