"""The driver's tables in the shapes that operators take, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as messages: the type as channel, type and properties as text, errors as bots."""
    e = table(spark, sf_dir, "events")
    country = F.when(F.col("user_id") % 4 == 0, "br").when(F.col("user_id") % 4 == 1, "lk").when(F.col("user_id") % 4 == 2, "de")
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("channel"), "ts", F.concat_ws(" ", "event_type", "props").alias("text"),
        F.col("user_id").alias("sender_id"), (F.col("event_type") == "error").alias("is_bot"), country.alias("country"),
    )


MESSAGES = """(select event_id::varchar as id, event_type as channel, ts, event_type || ' ' || props as text, user_id as sender_id, event_type = 'error' as is_bot,
  case user_id % 4 when 0 then 'br' when 1 then 'lk' when 2 then 'de' end as country from events)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as replies: each turn answers the one before, a minute later."""
    c = table(spark, sf_dir, "conversations")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 86_400 + F.col("turn") * 60)
    key = lambda turn: F.concat_ws("_", F.col("conv_id").cast("string"), turn.cast("string"))
    return c.select(key(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, key(F.col("turn") - 1)).alias("reply_to"), at.alias("ts"), "text", "role", "conv_id", "turn", F.concat(F.lit("c"), (F.col("conv_id") % 7).cast("string")).alias("channel"))


TURNS = """(select conv_id::varchar || '_' || turn::varchar as id, case when turn > 0 then conv_id::varchar || '_' || (turn - 1)::varchar end as reply_to,
  1700000000 + conv_id * 86400 + turn * 60 as said, text, role, conv_id, turn, 'c' || (conv_id % 7)::varchar as channel from conversations)"""


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as extracted patterns: the language as country, the source as tag, ids as age."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("country"), F.col("source").alias("tag"), F.col("text").alias("body"), ((F.col("doc_id") * 7919) % 10_007).alias("stamp"))


PATTERNS = "(select doc_id as id, lang as country, source as tag, text as body, (doc_id * 7919) % 10007 as stamp from documents)"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as posts: toxic ones to channel a, others to b."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pattern_id"), F.when(F.col("toxic") == 1, "a").otherwise("b").alias("channel"), (F.col("doc_id") % 997).alias("posted_at"))


POSTS = "(select doc_id as pattern_id, case when toxic = 1 then 'a' else 'b' end as channel, doc_id % 997 as posted_at from labels)"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as (id, v, label): unit vectors."""
    from tidemill.functions.vectors import normalized

    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), normalized(F.col("embedding")).alias("v"), "label")


UNITS = """(select vec_id as id, label, list_transform(embedding::double[], lambda x: x / sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y)))) as v from embeddings)"""
