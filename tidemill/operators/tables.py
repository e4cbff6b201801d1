"""Table semantics on immutable DataFrames: insert-or-ignore, upsert, patch, counters, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_if_absent(table: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """SNK-01..04: rows of new whose key the table lacks; of several with one key the first by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return first.join(table.select(*keys), [*keys], "left_anti").select(*new.columns)


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str], version: Column) -> DataFrame:
    """SNK-05, SNK-20: both tables' rows, the latest version of each key; new rows win ties."""
    both = table.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(version.desc(), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """WIN-06: the first row of each key by order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def patch(table: DataFrame, changes: DataFrame, keys: Sequence[str], *, only_nulls: bool = False) -> DataFrame:
    """SNK-09, 15, 16, 19: table with the columns of changes put in, all or where null; changes has each key once at most."""
    cols = [c for c in changes.columns if c not in keys]
    right = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in cols])
    joined = table.join(right, [*keys], "left")
    pick = (lambda c: F.coalesce(F.col(c), F.col(f"__{c}"))) if only_nulls else (lambda c: F.coalesce(F.col(f"__{c}"), F.col(c)))
    return joined.select(*[pick(c).alias(c) if c in cols else F.col(c) for c in table.columns])


def aged(table: DataFrame, stamp: str, now, days: int, flag: str) -> DataFrame:
    """SNK-10: flag set where the stamp is older than so many days."""
    old = F.col(stamp) < F.lit(now) - F.expr(f"INTERVAL {int(days)} DAYS")
    return table.withColumn(flag, F.when(old, F.lit(1)).otherwise(F.col(flag)))


def failures(events: DataFrame, key: str, error: str) -> DataFrame:
    """SNK-12, WIN-16: failures per key, the last error cut to 500 characters, and whether it is dead (three or more)."""
    return events.groupBy(key).agg(F.count("*").alias("failed"), F.substring(F.max_by(error, "ts"), 1, 500).alias("last_error")).withColumn("dead", F.col("failed") >= 3)


def pending(rows: DataFrame, limit: int) -> DataFrame:
    """TOP-05: rows not embedded, with under five failures, oldest first."""
    return rows.where(F.col("embedded_at").isNull() & (F.col("failed") < 5)).orderBy("stamp", "id").limit(limit)


def alternate_keys(sources: DataFrame) -> DataFrame:
    """JON-04, 05, 06: (key, country, priority) for chat id, name and handle of each source; the smallest (source, kind) wins a key."""
    keys = F.posexplode(F.array(F.col("chat_id").cast("string"), F.col("name"), F.col("handle"))).alias("kind", "key")
    return latest(sources.select("id", "country", keys).where("key is not null and key <> ''"), ["key"], [F.asc("id"), F.asc("kind")]).select("key", "country")


def with_country(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """SNK-15: country filled in by channel where it is null; sources are a dimension of a few rows per channel."""
    known = alternate_keys(sources).select(F.col("key").alias("channel"), F.col("country").alias("__country"))
    return messages.join(known, "channel", "left").withColumn("country", F.coalesce("country", "__country")).drop("__country")


def dump_files(messages: DataFrame) -> DataFrame:
    """SNK-22: one text per country, channel and day: a head line, then the messages in order."""
    lines = F.array_sort(F.collect_list(F.struct("ts", "id", "line")))
    day = F.to_date("ts").alias("day")
    out = messages.groupBy("country", "channel", day).agg(lines.alias("rows"))
    head = F.concat_ws(" ", F.lit("#"), "country", "channel", F.col("day").cast("string"))
    return out.select("country", "channel", "day", F.size("rows").alias("n"), F.concat_ws("\n", head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("body"))


def changed_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """SNK-24: files new or changed since the manifest (name, mtime)."""
    old = manifest.select("name", F.col("mtime").alias("__old"))
    return listing.join(old, "name", "left").where(~F.col("mtime").eqNullSafe(F.col("__old"))).drop("__old")


def kept_dates(new: DataFrame, old: DataFrame, key: str, content: Column, date: str) -> DataFrame:
    """SNK-25, AGG-16, PG-08: new rows, with the old date where the content is the same."""
    was = old.select(key, F.col(date).alias("__date"), content.alias("__was"))
    same = F.col("__was").eqNullSafe(content)
    return new.join(was, key, "left").withColumn(date, F.when(same, F.col("__date")).otherwise(F.col(date))).withColumn("changed", ~same).drop("__date", "__was")
