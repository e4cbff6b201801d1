"""Pending texts through an embedder, micro-batch by micro-batch, with state that survives a restart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.ranking import numbered
from tidemill.sources.store import cut_lineage

#: Failures after which a row is dropped.
STRIKES = 5
WAITING = "id {id}, text string, arrived int, failures int, error string"
DONE = "id {id}, text string, failures int, day string, v array<double>"


def _read(spark: SparkSession, path: str, schema: str, batch: int, last: bool = False) -> DataFrame | None:
    """What batches before `batch` wrote, or only the last of them; None before the first. Each batch writes each of its folders, if without rows."""
    if not batch:
        return None
    if last:
        return spark.read.schema(schema).parquet(f"{path}/batch={batch - 1}")
    return spark.read.schema(f"{schema}, batch int").parquet(path).where(F.col("batch") < batch)


def _turn(rows: DataFrame, left: int) -> Column:
    """Which rows are the first `left` by arrived and id: a condition on the two. No row of a text is moved, and none of any kind through one task."""
    if left <= 0:
        return F.lit(False)
    keys = rows.select("arrived", "id")
    if keys.count() <= left:
        return F.lit(True)
    last = numbered(keys, [], ["arrived", "id"]).where(F.col("position") == left).first()
    return (F.col("arrived") < last["arrived"]) | ((F.col("arrived") == last["arrived"]) & (F.col("id") <= F.lit(last["id"])))


def pump(embed: Callable[[DataFrame], DataFrame], state: str, day: str, quota: int, *, junk: Callable[[DataFrame], DataFrame] | None = None, strikes: int = STRIKES) -> Callable[[DataFrame, int], None]:
    """STR-09, SRC-18: a handler for foreachBatch over arriving rows (id, text); see streams.each_batch.

    A batch takes what waits from the batch before and what arrives (a null id is a tick, that
    only lets what waits be tried again), in order of arrival and id, as far as the day's quota of attempts goes. `embed` gives
    rows (id, text, arrived, failures, error) a vector v, or null where it failed. A failed row waits with its count of failures, and
    is dropped at `strikes`; a blank text fails without an attempt. What the quota does not reach waits without blame. Rows
    that `junk` gives back are done without a vector. An id that was done, dropped or waits already is not taken again.

    Each batch writes its own folders (points, dropped, waiting, attempts) by its number, and reads those of
    earlier batches only. So a batch that was killed anywhere writes the same rows when the checkpoint runs it again.
    """

    def handle(arrived: DataFrame, batch: int) -> None:
        spark = arrived.sparkSession
        kind = arrived.schema["id"].dataType.simpleString()
        waiting_schema, done_schema = WAITING.format(id=kind), DONE.format(id=kind)
        before = _read(spark, f"{state}/waiting", waiting_schema, batch, last=True)
        done = _read(spark, f"{state}/points", done_schema, batch)
        dropped = _read(spark, f"{state}/dropped", waiting_schema, batch)
        used = _read(spark, f"{state}/attempts", "day string, n long", batch)
        left = max(0, quota - ((used.where(F.col("day") == day).agg(F.sum("n")).first()[0] or 0) if used is not None else 0))

        new = arrived.where("id is not null").groupBy("id").agg(F.min("text").alias("text"))
        for known in (before, done, dropped):
            if known is not None:
                new = new.join(known.select("id"), "id", "left_anti")
        new = new.select("id", "text", F.lit(batch).alias("arrived"), F.lit(0).alias("failures"), F.lit(None).cast("string").alias("error"))
        # What waits lies in files already.
        new = cut_lineage(new)
        todo = new if before is None else before.select(*new.columns).unionByName(new)

        # Texts stay where todo lies: the junk's ids, few of all, are read again as a small side, and a border in (arrived, id) tells whose turn it is.
        useless = cut_lineage(junk(todo).select("id").distinct()) if junk else None
        able = todo if useless is None else todo.join(useless, "id", "left_anti")
        blank = F.coalesce(F.trim("text"), F.lit("")) == ""
        turn = _turn(able.where(~blank), left)
        tried = cut_lineage(embed(able.where(~blank & turn)))
        failed = tried.where("v is null").select("id", "text", "arrived", (F.col("failures") + 1).alias("failures"), F.lit("no vector").alias("error"))
        empty = able.where(blank).select("id", "text", "arrived", (F.col("failures") + 1).alias("failures"), F.lit("empty text").alias("error"))
        late = able.where(~blank & ~turn)
        points = tried.where("v is not null").select("id", "text", "failures", F.lit(day).alias("day"), "v")
        if useless is not None:
            points = points.unionByName(todo.join(useless, "id", "left_semi").select("id", "text", "failures", F.lit(day).alias("day"), F.lit(None).cast("array<double>").alias("v")))
        blamed = failed.unionByName(empty)

        def write(rows: DataFrame, name: str) -> None:
            rows.write.mode("overwrite").parquet(f"{state}/{name}/batch={batch}")

        write(points, "points")
        write(blamed.where(F.col("failures") >= strikes), "dropped")
        write(tried.agg(F.lit(day).alias("day"), F.count("*").alias("n")), "attempts")
        write(late.unionByName(blamed.where(F.col("failures") < strikes)), "waiting")

    return handle


def pumped(spark: SparkSession, state: str, id_type: str, batches: int) -> DataFrame:
    """Where each row stands after so many batches: id, status (embedded, skipped, dropped, waiting), failures, batch (waiting: that of its arrival)."""
    done = _read(spark, f"{state}/points", DONE.format(id=id_type), batches)
    dropped = _read(spark, f"{state}/dropped", WAITING.format(id=id_type), batches)
    waiting = _read(spark, f"{state}/waiting", WAITING.format(id=id_type), batches, last=True)
    return (
        done.select("id", F.when(F.col("v").isNull(), "skipped").otherwise("embedded").alias("status"), "failures", "batch")
        .unionByName(dropped.select("id", F.lit("dropped").alias("status"), "failures", "batch"))
        .unionByName(waiting.select("id", F.lit("waiting").alias("status"), "failures", F.col("arrived").alias("batch")))
    )
