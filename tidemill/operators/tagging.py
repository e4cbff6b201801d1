"""Labels for rows in runs that leave state: what is done, what failed how often, and views once nothing is left."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.store import cut_lineage

#: Failures after which a row is dead.
DEAD_AT = 3
#: A run with so many failures and no success blames nobody.
SYSTEMIC = 3
#: Members that make a page.
PAGE_MIN = 4
DONE, FAILS = "id {id}, labels array<string>", "id {id}, failures int"


class Report(NamedTuple):
    new: int
    remaining: int
    stopped: bool


def _state(spark: SparkSession, state: str, run: int, id_type: str) -> tuple[DataFrame, DataFrame]:
    """What runs before `run` left: done (id, labels, run) of all of them, and fails (id, failures) of the last."""
    done, fails = DONE.format(id=id_type) + ", run int", FAILS.format(id=id_type)
    if not run:
        return spark.createDataFrame([], done), spark.createDataFrame([], fails)
    return spark.read.schema(done).parquet(f"{state}/done").where(F.col("run") < run), spark.read.schema(fails).parquet(f"{state}/fails/run={run - 1}")


def _left(rows: DataFrame, done: DataFrame, fails: DataFrame) -> DataFrame:
    dead = fails.where(F.col("failures") >= DEAD_AT)
    return rows.join(done.select("id").unionByName(dead.select("id")), "id", "left_anti")


def tag_run(rows: DataFrame, tag: Callable[[DataFrame], DataFrame], state: str, run: int, limit: int | None = None) -> Report:
    """VEC-20: one run over rows (id, ...): the next `limit` that are neither done nor dead, by id, get labels.

    `tag` gives rows (id, labels), null labels where it failed; a row it does not give back failed too. Failures are counted across runs, and a row is
    dead at three. A run with three failures or more and no success is no row's fault: nothing is counted, and it
    counts as stopped. State is a folder per run and table, written over if a run is repeated; ids must be
    distinct and not null.
    """
    spark, id_type = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    done, fails = _state(spark, state, run, id_type)
    todo = _left(rows, done, fails)
    # Ids alone are ordered; the rows meet those that come next.
    todo = cut_lineage(todo if limit is None else todo.join(todo.select("id").orderBy("id").limit(limit), "id", "left_semi"))
    tagged = cut_lineage(tag(todo).select("id", "labels"))
    good = tagged.where("labels is not null")
    bad = todo.select("id").join(good, "id", "left_anti")
    n_good, n_bad = good.count(), bad.count()
    stopped = not n_good and n_bad >= SYSTEMIC
    if not stopped:
        fails = fails.unionByName(bad.select("id", F.lit(1).alias("failures"))).groupBy("id").agg(F.sum("failures").cast("int").alias("failures"))
    good.write.mode("overwrite").parquet(f"{state}/done/run={run}")
    fails.write.mode("overwrite").parquet(f"{state}/fails/run={run}")
    return Report(n_good, _left(rows, *_state(spark, state, run + 1, id_type)).count(), stopped)


def tag_state(rows: DataFrame, state: str, runs: int) -> DataFrame:
    """Where each row stands after so many runs: id, run (that labelled it), labels, failures, dead."""
    done, fails = _state(rows.sparkSession, state, runs, rows.schema["id"].dataType.simpleString())
    failures = F.coalesce("failures", F.lit(0))
    return rows.select("id").join(done, "id", "left").join(fails, "id", "left").select("id", "run", "labels", failures.alias("failures"), ((failures >= DEAD_AT) & F.col("labels").isNull()).alias("dead"))


def label_mass(tagged: DataFrame) -> DataFrame:
    """AGG-12: (shelf, label, n): how many rows (shelf, labels) of a shelf bear a label; blank labels do not count."""
    each = tagged.select("id", "shelf", F.explode(F.array_distinct(F.transform("labels", lambda x: F.trim(x)))).alias("label"))
    return each.where("label <> ''").groupBy("shelf", "label").agg(F.count("*").alias("n"))


def views(tagged: DataFrame, stalled: DataFrame, home: Column, least: int = PAGE_MIN) -> DataFrame:
    """VEC-20's views, SET-07, MSC-13: (id, shelf, kind, name) of rows (id, shelf, labels).

    A label with `least` rows of a shelf makes a page of it, and its rows are on it: kind `page`. Rows on no page
    that are not stalled are the tail; `home` names the shelf that takes one in: kind `shelf`, or `other` where it is null. Stalled
    rows (id) on no page are left out. A common label is a number before it meets its rows again.
    """
    mass = label_mass(tagged).where(F.col("n") >= least).select(F.col("shelf").alias("__shelf"), F.col("label").alias("name"))
    each = tagged.select("id", "shelf", F.explode(F.array_distinct(F.transform("labels", lambda x: F.trim(x)))).alias("name"))
    paged = each.join(mass.withColumnRenamed("name", "__name"), F.col("shelf").eqNullSafe(F.col("__shelf")) & (F.col("name") == F.col("__name"))).select("id", "shelf", F.lit("page").alias("kind"), "name")
    paged = cut_lineage(paged)
    tail = tagged.join(paged.select("id"), "id", "left_anti").join(stalled.select("id"), "id", "left_anti")
    at_home = tail.select("id", "shelf", home.alias("name"))
    return paged.unionByName(at_home.select("id", "shelf", F.when(F.col("name").isNull(), "other").otherwise("shelf").alias("kind"), F.coalesce("name", F.lit("other")).alias("name")))
