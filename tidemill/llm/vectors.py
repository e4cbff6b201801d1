"""What the vector operators share: valid rows, and rows in sorted blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that an orthogonal basis is fitted on, at most; it bears on speed alone.
BASIS_ROWS = 2048


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not zero, and all its components are finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel(), kind))


def basis(vectors: DataFrame, seed: int) -> np.ndarray | None:
    """Orthonormal rows, leading principal direction first, of the vectors' column `v`.

    Fitted on the BASIS_ROWS rows of the smallest seeded hash of their id.
    """
    sample = vectors.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(BASIS_ROWS).select("v").collect()
    if not sample:
        return None
    x = np.array([r["v"] for r in sample], np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    values, axes = np.linalg.eigh(np.cov(x, rowvar=False) if len(x) > 1 else np.eye(x.shape[1]))
    return axes[:, np.argsort(-values)].T


def in_blocks(df: DataFrame, order: list[str], columns: list[str], group: list[str], size: int, schema: str) -> DataFrame:
    """Rows of df, in order, cut into blocks: group columns, part, number, n and one list per column.

    Rows are range-partitioned by `order`, which must begin with `group` and end
    with a unique column, so a common key spreads over partitions. A block has
    at most `size` rows, of one group and one partition; partitions and numbers order them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, []

        def close(table: pa.Table) -> pa.RecordBatch:
            nonlocal number
            arrays = [table[g].combine_chunks()[:1] for g in group]
            arrays += [pa.array([x], pa.int64()) for x in (part, number, table.num_rows)]
            for c in columns:
                values = table[c].combine_chunks()
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
            number += 1
            return pa.RecordBatch.from_arrays(arrays, names=[*group, "part", "number", "n", *columns])

        def blocks(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            codes = np.zeros(table.num_rows, bool)
            for g in group:
                values = table[g].combine_chunks()
                codes[1:] |= np.asarray(values[1:]) != np.asarray(values[:-1])
            starts = [0, *np.flatnonzero(codes).tolist(), table.num_rows]
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                while hi - lo > size or hi - lo and (last or hi < table.num_rows):
                    n = min(size, hi - lo)
                    yield close(table.slice(lo, n))
                    lo += n
                if hi == table.num_rows:
                    held = [table.slice(lo, hi - lo)]

        for batch in batches:
            yield from blocks(pa.concat_tables([*held, pa.Table.from_batches([batch])]), False)
        if held:
            yield from blocks(pa.concat_tables(held), True)

    sorted_rows = df.select(*dict.fromkeys([*order, *columns])).repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(cut, schema)
