"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, sized

#: Rows of a bucket beyond which it is scattered further.
MAX_BUCKET_ROWS = 200_000


def external_shuffle(df: DataFrame, *, id_col: str, size_col: str, seed: int = 11, bucket_bytes: int = 16 << 20) -> DataFrame:
    """All rows of df in uniformly random order: its columns, `bucket` and `place` in the bucket.

    First pass: a seeded hash of the id scatters the rows over buckets of about
    bucket_bytes. Second pass: each bucket is put in a fixed order and shuffled
    (Fisher-Yates, seeded by the bucket), and the result is written to the shared
    folder. A bucket that repeated ids would overfill is spread over sub-buckets by row.
    Columns of df called bucket, place or __order are replaced.
    """
    total = df.agg(F.sum(size_col)).first()[0] or 0
    n = max(1, -(-int(total) // bucket_bytes))
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))
    heavy = df.select(F.pmod(key, F.lit(n)).alias("b"), F.col(size_col).alias("s")).groupBy("b").agg(F.sum("s").alias("s"), F.count("*").alias("c"))
    heavy = heavy.where((F.col("s") > 4 * bucket_bytes) | (F.col("c") > MAX_BUCKET_ROWS)).select(
        F.col("b").alias("__bucket"), F.ceil(F.greatest(F.col("s") / bucket_bytes, F.col("c") * 4 / MAX_BUCKET_ROWS)).cast("long").alias("__parts")
    )
    heavy = sized(materialize(heavy))
    names = [c for c in df.columns if c not in ("bucket", "place", "__order")]
    # A row's number in its scan tells apart rows that share an id; it spreads those of a heavy bucket only.
    rows = df.select(*names, F.pmod(key, F.lit(n)).alias("__bucket"), F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("__row"))
    rows = rows.join(heavy, "__bucket", "left")
    rows = rows.withColumn("bucket", F.concat_ws("/", F.col("__bucket").cast("string"), F.pmod("__row", F.col("__parts")).cast("string")))
    # Rows that share an id are told apart by what else they hold, so that reruns agree; equal rows are interchangeable.
    content = F.xxhash64(F.lit(seed + 1), *[F.col(c) for c, t in df.select(*names).dtypes if "map<" not in t and t != "variant"])
    rows = rows.select(*names, "bucket", F.struct(F.xxhash64(F.lit(seed + 1), F.col(id_col).cast("string")).alias("id"), content.alias("row")).alias("__order"))
    schema = T.StructType([*rows.select(*names, "bucket").schema.fields, T.StructField("place", T.LongType())])

    def shuffle(key: tuple, bucket: pa.Table) -> pa.Table:
        by = bucket["__order"].combine_chunks()
        order = np.lexsort((np.asarray(by.field("row")), np.asarray(by.field("id"))))
        bucket = bucket.take(pa.array(order)).drop_columns(["__order"])
        random = np.random.default_rng([seed, *key[0].as_py().encode()])
        perm = np.arange(bucket.num_rows)
        random.shuffle(perm)
        return bucket.take(pa.array(perm)).append_column("place", pa.array(np.arange(bucket.num_rows), pa.int64()))

    return materialize(rows.groupBy("bucket").applyInArrow(shuffle, schema))


def shard_rows(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, seed: int = 11, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Every row of df with its `shard` and `slot`, in uniformly random order.

    The shuffled buckets follow one another; counting off their rows deals them
    to the shards in turn, so counts differ by one at most and slots have no
    gaps. Other columns come back unchanged (columns already called bucket,
    place, shard or slot are replaced). Null ids are rows like any other, as are
    null texts; equal rows are each placed. An empty table gives none.
    """
    rows = df.withColumn("__size", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8)
    shuffled = external_shuffle(rows, id_col=id_col, size_col="__size", seed=seed, bucket_bytes=bucket_bytes)
    # One row per bucket: the number of rows in those before it.
    before = shuffled.groupBy("bucket").agg(F.count("*").alias("rows")).withColumn("before", F.sum("rows").over(Window.orderBy("bucket")) - F.col("rows"))
    before = sized(materialize(before.select("bucket", "before")))
    at = F.col("before") + F.col("place")
    return (
        shuffled.join(before, "bucket")
        .withColumn("shard", F.pmod(at, F.lit(shards)).cast("int"))
        .withColumn("slot", F.floor(at / F.lit(shards)).cast("long"))
        .select(*[c for c in df.columns if c not in ("bucket", "place", "shard", "slot")], "shard", "slot")
    )
