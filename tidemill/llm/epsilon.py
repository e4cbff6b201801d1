"""Embedding near-duplicates by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import materialize
from .graph import connected_components

#: Vectors in a block of the grid order. Two blocks meet in a task.
BLOCK = 1024
#: Sequences up to this long are compared at once.
LEAF = 128
#: Leading principal dimensions that make the grid.
GRID = 4


def join_sequences(a: tuple, b: tuple, reach: float, same: bool, compare) -> None:
    """Recursive join of two sequences in grid order: (first row, projected rows).

    Two intervals whose bounding boxes are further apart than reach hold no
    pair and are left; small ones are compared; others are halved.
    """
    (at_a, x), (at_b, y) = a, b
    if not len(x) or not len(y):
        return
    gap = np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
    if not same and float(gap @ gap) > reach * reach:
        return
    if len(x) <= LEAF and len(y) <= LEAF:
        compare(at_a, at_a + len(x), at_b, at_b + len(y))
        return

    def halves(at: int, rows: np.ndarray) -> list[tuple]:
        if len(rows) <= LEAF:
            return [(at, rows)]
        mid = len(rows) // 2
        return [(at, rows[:mid]), (at + mid, rows[mid:])]

    for i, p in enumerate(halves(at_a, x)):
        for j, q in enumerate(halves(at_b, y)):
            if not same or j >= i:
                join_sequences(p, q, reach, same and i == j, compare)


def _labels(linked: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Smallest row connected to each of n rows."""
    label = np.arange(n)
    if not linked:
        return label
    u, v = np.concatenate([p for p, _ in linked]), np.concatenate([q for _, q in linked])
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def near_vectors(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, seed: int = 3) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row; vectors of one label link at a cosine of threshold or more.

    1. Equal vectors of a label become one, with its smallest id and its count.
    2. On unit vectors a cosine c is a distance sqrt(2 - 2c) = eps. Rotated to principal
       directions, vectors are sorted by their cells of side eps on the leading
       ones (the epsilon grid order) and cut into blocks.
    3. Blocks of a label are paired where their bounding boxes come within eps: they share a
       slab of the first direction, which an equality join finds, and the first slab they share counts.
    4. Two blocks are joined by recursion on their intervals. A task returns, per vector,
       how many links it found, and edges that connect what is linked,
       at most one per vector: no list of pairs leaves it.

    Ids are unique integers. Null, zero and non-finite vectors, and those with a null label, link with
    nothing: n_links 0, component_id their own id. Vectors all have one length.
    An empty table gives none. Other columns are ignored.
    """
    eps = float(np.sqrt(2 - 2 * threshold))
    every = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    valid = every.where(vectors.usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    axes = vectors.basis(valid, seed)
    unique = valid.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = vectors.matrix(batch.column("v"))
                y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes.T
                cells = np.floor(y[:, :GRID] / eps).astype(np.int64)
                columns = [batch.column("label"), *(pa.array(cells[:, k] if k < cells.shape[1] else np.zeros(len(x), np.int64)) for k in range(GRID))]
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c) for c in ("id", "copies", "v"))], names=[f.split()[0] for f in grid_schema.split(", ")])

    label_type, id_type, v_type = (every.schema[c].dataType.simpleString() for c in ("label", "id", "v"))
    cells = [f"c{k}" for k in range(GRID)]
    grid_schema = f"label {label_type}, " + ", ".join(f"{c} long" for c in cells) + f", id {id_type}, copies long, v {v_type}"
    gridded = unique.select("label", "id", "copies", "v").mapInArrow(project, grid_schema)
    block_schema = f"label {label_type}, part long, number long, n long, id array<{id_type}>, copies array<long>, v array<{v_type}>"
    blocks = vectors.in_blocks(gridded, ["label", *cells, "id"], ["id", "copies", "v"], ["label"], BLOCK, block_schema)
    blocks = materialize(blocks.withColumn("block", F.struct("part", "number")))

    def unit(lists: pa.Array) -> np.ndarray:
        x = vectors.matrix(lists)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = [], []
            for k in range(batch.num_rows):
                y = unit(batch.column("v")[k].values) @ axes[:GRID].T
                lo.append(y.min(0).tolist())
                hi.append(y.max(0).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "part", "number")), pa.array(lo, pa.list_(pa.float64())), pa.array(hi, pa.list_(pa.float64()))], names=["label", "part", "number", "lo", "hi"])

    box = blocks.select("label", "part", "number", "v").mapInArrow(boxes, f"label {label_type}, part long, number long, lo array<double>, hi array<double>")
    slab = lambda c: F.floor(F.col(c)[0] / eps).cast("long")
    box = box.select("label", F.struct("part", "number").alias("block"), "lo", "hi", slab("lo").alias("from"), F.explode(F.sequence(slab("lo"), slab("hi") + 1)).alias("slab"))
    a, b = box.alias("a"), box.alias("b")
    apart = F.zip_with(F.zip_with("a.lo", "b.hi", lambda p, q: p - q), F.zip_with("b.lo", "a.hi", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    meets = F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x) <= (eps * 1.0001) ** 2
    first_shared = F.col("a.slab") == F.greatest("a.from", "b.from")
    pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.slab") == F.col("b.slab")) & (F.col("a.block") <= F.col("b.block")) & first_shared & meets)
    pairs = pairs.select(F.col("a.block").alias("x"), F.col("b.block").alias("y"))
    left = blocks.select(F.col("block").alias("x"), *(F.col(c).alias(f"x_{c}") for c in ("id", "copies", "v")))
    right = blocks.select(F.col("block").alias("y"), *(F.col(c).alias(f"y_{c}") for c in ("id", "copies", "v")))
    met = pairs.join(left, "x").join(right, "y")
    met = met.select((F.col("x") == F.col("y")).alias("same"), *left.columns[1:], *right.columns[1:])

    def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column("same")[k].as_py()
                x, y = (unit(batch.column(f"{s}_v")[k].values) for s in "xy")
                ids = [np.asarray(batch.column(f"{s}_id")[k].values) for s in "xy"]
                copies = [np.asarray(batch.column(f"{s}_copies")[k].values) for s in "xy"]
                counts, linked = [np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)], []

                def compare(a0: int, a1: int, b0: int, b1: int) -> None:
                    hit = x[a0:a1] @ y[b0:b1].T >= threshold  # noqa: B023
                    if same and a0 == b0:  # noqa: B023
                        np.fill_diagonal(hit, False)
                    if hit.any():
                        counts[0][a0:a1] += hit @ copies[1][b0:b1]  # noqa: B023
                        if not same or a0 != b0:  # noqa: B023
                            counts[1][b0:b1] += copies[0][a0:a1] @ hit  # noqa: B023
                        u, v = np.nonzero(hit)
                        linked.append((u + a0, v + b0 + (0 if same else len(x))))  # noqa: B023

                join_sequences((0, x @ axes.T), (0, y @ axes.T), eps * 1.0001, same, compare)
                label = _labels(linked, len(x) if same else len(x) + len(y))
                names = ids[0] if same else np.concatenate(ids)
                total = counts[0] + counts[1] if same else np.concatenate(counts)
                some = np.flatnonzero((total > 0) | (label != np.arange(len(label))))
                yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(total[some]), pa.array(names[label[some]])], names=["id", "links", "with"])

    part = materialize(met.mapInArrow(compare_blocks, f"id {id_type}, links long, with {id_type}"))
    components = connected_components(part.select(F.col("id").alias("u"), F.col("with").alias("v")))
    links = part.groupBy("id").agg(F.sum("links").alias("links"))
    reps = (
        unique.join(links, "id", "left").join(components, F.col("id") == F.col("node"), "left")
        .select(F.col("label").alias("r_label"), F.col("v").alias("r_v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    linked_rows = valid.join(reps, (F.col("label") == F.col("r_label")) & (F.col("v") == F.col("r_v"))).select("id", "n_links", "component_id")
    alone = every.where(~(vectors.usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull())).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked_rows.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
