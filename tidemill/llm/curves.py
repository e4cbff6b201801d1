"""Approximate nearest neighbours by shifted space-filling curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .common import materialize

#: Rows in a block, the unit in which windows are measured; blocks that a task reads together; and queries that meet them at a time.
BLOCK = 64
TILE = 64
ASKED = 4096
#: Vectors that the width of the windows is calibrated on, and the share of their neighbours that windows must hold.
CALIBRATE = 64
HELD = 0.95


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer cells (n, d) with `bits` bits each, d * bits up to 63."""
    x = cells.astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of each level, from the coarsest
        low = q - 1
        for axis in range(len(x)):
            on = (x[axis] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(on, low, swap)
            x[axis] ^= swap if axis else 0
        q >>= 1
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            key = key << 1 | (x[axis] >> bit & 1)
    return key


class Orderings:
    """Several shifted Hilbert orderings of projections, laid out by a bounded sample."""

    def __init__(self, sample: np.ndarray, axes: np.ndarray, curves: int, dims: int, bits: int, seed: int):
        random = np.random.default_rng(seed)
        lead = axes[: max(dims, min(len(axes), curves * dims))]
        self.dims, self.bits = min(dims, len(lead)), bits
        self.views = []
        for c in range(curves):
            turn = np.linalg.qr(random.normal(size=(len(lead), len(lead))))[0]
            view = (turn @ lead)[: self.dims]
            y = sample @ view.T
            low, span = y.min(0), np.maximum(np.ptp(y, axis=0), 1e-12)
            # Each curve lays its own shifted cube around the points.
            self.views.append((view, low - span * random.uniform(0, 0.3, self.dims), span * 1.35))

    def keys(self, x: np.ndarray) -> list[np.ndarray]:
        top = (1 << self.bits) - 1
        return [hilbert_keys(np.clip((x @ view.T - low) / span * (top + 1), 0, top).astype(np.int64), self.bits) for view, low, span in self.views]


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(1))


def nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int, rough: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k rows of x nearest to q, but own; ties to the smaller id.

    rough holds squared distances that rounding may have changed a little: they pick the rows
    that are measured exactly.
    """
    if rough is not None and len(rough) > 4 * k:
        slack = 1e-9 * (1 + float(q @ q) + float(np.abs(rough[np.isfinite(rough)]).max(initial=0)))
        near = np.flatnonzero(rough <= np.partition(rough, k)[k] + slack)
        x, ids = x[near], ids[near]
    far = distances(x, q)
    far[ids == own] = np.inf
    best = np.lexsort((ids, far))[:k]
    best = best[np.isfinite(far[best])]
    return ids[best], far[best]


def search(
    rows: DataFrame,
    queries: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    curves: int = 4,
    dims: int = 4,
    bits: int = 15,
    seed: int = 5,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by Euclidean distance for each row where `queries` holds.

    1. Vectors are projected on a few of their leading principal directions, turned at
       random for each curve, and keyed by their place on a shifted Hilbert curve.
    2. Every curve's ordering is range-partitioned and cut into blocks. For a bounded
       sample of CALIBRATE vectors the true neighbours are found by one pass over
       all rows; the window is the number of blocks to either side within which some
       curve holds HELD of them. So the width follows the data: narrow where vectors cluster, wide where they have no structure.
    3. Queries go to the tiles (runs of TILE blocks) within their windows on all curves, in bundles of some
       ASKED neighbours; a tile's vectors move once for each bundle that reaches it. Each task reranks by
       exact distance in double precision, and the windows' best merge.

    Rows take no part whose vector is null, zero or holds null or non-finite components.
    Of equal vectors only the k + 1 of smallest id can be among anyone's nearest, so no more are
    searched; all are asked for. Ids are unique integers, vectors of one length.
    Rows with a null id neither ask nor are found. An empty table gives none. Other columns are ignored.
    """
    spark = rows.sparkSession
    valid = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(vectors.usable(F.col("v")) & F.col("id").isNotNull())
    order = Window.partitionBy("v").orderBy("id")
    able = valid.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("id", "v", "asks", F.lit(True).alias("able"))
    only_asks = valid.where("asks").join(able.select("id"), "id", "left_anti").select("id", "v", "asks", F.lit(False).alias("able"))
    points = materialize(able.unionByName(only_asks))
    id_type, v_type = points.schema["id"].dataType.simpleString(), points.schema["v"].dataType.simpleString()
    out = f"query_id {id_type}, vec_id {id_type}, score double"
    axes = vectors.basis(points, seed)
    if axes is None:
        return spark.createDataFrame([], out).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    sample = points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(vectors.BASIS_ROWS).select("id", "v").collect()
    plan = Orderings(np.array([r["v"] for r in sample], np.float64), axes, curves, dims, bits, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for c, key in enumerate(plan.keys(vectors.matrix(batch.column("v")))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c), pa.int32()), pa.array(key), *batch.columns], names=["curve", "key", *batch.schema.names])

    placed = points.mapInArrow(place, f"curve int, key long, id {id_type}, v {v_type}, asks boolean, able boolean")
    block_schema = f"curve int, part long, number long, n long, id array<{id_type}>, v array<{v_type}>, asks array<boolean>, able array<boolean>"
    blocks = materialize(vectors.in_blocks(placed, ["curve", "key", "id"], ["id", "v", "asks", "able"], ["curve"], BLOCK, block_schema))
    # A block's place on its curve: those of earlier partitions, one row each, come before.
    parts = blocks.groupBy("curve", "part").agg(F.min("number").alias("from"), F.count("*").alias("blocks"))
    parts = parts.withColumn("before", F.sum("blocks").over(Window.partitionBy("curve").orderBy("part")) - F.col("blocks")).select("curve", "part", "from", "before")
    blocks = blocks.join(parts, ["curve", "part"]).withColumn("at", (F.col("before") + F.col("number") - F.col("from")).cast("int"))

    width = _window(blocks, points, sample[:CALIBRATE], k, curves, id_type)
    last = blocks.groupBy("curve").agg(F.max("at").alias("last"))
    # Queries before each block on its curve, by parts as above: they number the bundles.
    each = blocks.select("curve", "part", "at", F.size(F.filter("asks", lambda a: a)).cast("long").alias("asking"))
    earlier = each.groupBy("curve", "part").agg(F.sum("asking").alias("asking"))
    earlier = earlier.select("curve", "part", (F.sum("asking").over(Window.partitionBy("curve").orderBy("part")) - F.col("asking")).alias("asked_before"))
    within = F.sum("asking").over(Window.partitionBy("curve", "part").orderBy("at")) - F.col("asking")
    bundles = each.withColumn("within", within).join(earlier, ["curve", "part"]).select("curve", "at", F.floor((F.col("asked_before") + F.col("within")) / ASKED).alias("bundle"))
    tile_of = lambda at: F.floor(at / TILE).cast("int")
    asked = (
        blocks.where(F.exists("asks", lambda a: a)).join(last, "curve").join(bundles, ["curve", "at"])
        .select("curve", "at", "last", "bundle", F.explode(F.filter(F.arrays_zip("id", "v", "asks"), lambda x: x["asks"])).alias("q"))
        .select("curve", "at", "bundle", F.col("q.id").alias("q_id"), F.col("q.v").alias("q_v"),
                F.explode(F.sequence(tile_of(F.greatest(F.lit(0), F.col("at") - width)), tile_of(F.least(F.col("last"), F.col("at") + width)))).alias("tile"))
    )
    asked = materialize(asked)
    # A task has the blocks of one tile and one bundle of queries, so neither side grows with the table.
    reached = asked.select("curve", "tile", "bundle").distinct()
    tiles = blocks.select("curve", "at", "id", "v", "able", tile_of(F.col("at")).alias("tile")).join(reached, ["curve", "tile"])

    def rerank(block: pa.Table, asks: pa.Table) -> pa.Table:
        q_ids, ids_out, far_out = [], [], []
        if block.num_rows and asks.num_rows:
            at = np.repeat(np.asarray(block["at"]), [len(i) for i in block["id"]])
            ids = np.asarray(pa.concat_arrays([i.values for i in block["id"]]))
            x = np.concatenate([vectors.matrix(v.values) for v in block["v"]])
            able = np.asarray(pa.concat_arrays([a.values for a in block["able"]]).to_numpy(zero_copy_only=False))
            at, ids, x = at[able], ids[able], x[able]
            names, places, asking = asks["a_q_id"].to_pylist(), np.asarray(asks["a_at"]), vectors.matrix(asks["a_q_v"])
            length = (x * x).sum(1)
            for lo in range(0, len(names) if len(x) else 0, 256):
                some = slice(lo, lo + 256)
                rough = length - 2 * (asking[some] @ x.T) + (asking[some] * asking[some]).sum(1)[:, None]
                rough[np.abs(at - places[some, None]) > width] = np.inf
                for q, v, about in zip(names[some], asking[some], rough, strict=True):
                    inside = np.flatnonzero(np.isfinite(about))
                    found, far = nearest(x[inside], ids[inside], v, q, k, about[inside])
                    q_ids += [q] * len(found)
                    ids_out.append(found)
                    far_out.append(far)
        kind = asks["a_q_id"].type
        joined = lambda parts, t: pa.array(np.concatenate(parts) if parts else [], t)
        return pa.table({"query_id": pa.array(q_ids, kind), "vec_id": joined(ids_out, kind), "score": joined(far_out, pa.float64())})

    key = ["curve", "tile", "bundle"]
    asked = asked.select(*(F.col(c).alias(f"a_{c}") for c in key), *(F.col(c).alias(f"a_{c}") for c in ("at", "q_id", "q_v")))
    found = tiles.groupBy(*key).cogroup(asked.groupBy(*(f"a_{c}" for c in key))).applyInArrow(rerank, out)
    merged = found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return merged.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _window(blocks: DataFrame, points: DataFrame, sample: list, k: int, curves: int, id_type: str) -> int:
    """Blocks to either side that hold HELD of the sample's true neighbours on some curve."""
    asked = [(r["id"], np.array(r["v"], np.float64)) for r in sample]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            able = batch.filter(batch.column("able"))
            ids, x = np.asarray(able.column("id")), vectors.matrix(able.column("v"))
            for own, q in asked if len(ids) else []:
                found, far = nearest(x, ids, q, own, k, (x * x).sum(1) - 2 * (x @ q) + q @ q)
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(found), able.column("id").type), pa.array(found), pa.array(far)], names=["q", "id", "far"])

    true = points.select("id", "v", "able").mapInArrow(scan, f"q {id_type}, id {id_type}, far double")
    true = true.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("far", "id"))).where(F.col("n") <= k).select("q", "id").collect()
    wanted = points.sparkSession.createDataFrame([(i,) for i in {x for r in true for x in (r["q"], r["id"])}], f"id {id_type}")
    places = blocks.select("curve", "at", F.explode("id").alias("id")).join(F.broadcast(wanted), "id").collect()
    at = {(r["curve"], r["id"]): r["at"] for r in places}
    away = [min(abs(at[c, r["q"]] - at[c, r["id"]]) for c in range(curves)) for r in true]
    # Without two usable vectors nothing is near anything.
    return max(1, int(np.quantile(away, HELD, method="higher"))) if away else 1
