"""Tables in files: readers, writers and intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names, which executors share; on one machine without it, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tidemill-"))
        root = f"file://{_local[0]}"
    return f"{root.rstrip('/')}/step-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dimension(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A small table for broadcasting, such as categories or countries: its rows are counted, and more than `most` are refused."""
    n = df.count()
    if n > most:
        raise ValueError(f"a dimension of {n} rows exceeds {most}")
    return F.broadcast(df)


def claims_file(spark: SparkSession, path: str, country: str, min_answer: int = 10) -> DataFrame:
    """SRC-06: JSON lines of claims; malformed rows stay, with `_corrupt`, and short answers go."""
    schema = "question string, answer string, category string, confidence string, tags array<string>, source_msgs array<string>, _corrupt string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where(F.col("_corrupt").isNotNull() | (F.length(F.trim("answer")) >= min_answer)).withColumn("country", F.lit(country))


def sample_files(spark: SparkSession, path: str, done: DataFrame, limit: int | None = None) -> DataFrame:
    """SRC-07: text files (country, name, mtime, text) of country folders that are not in done (name), oldest first."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    rows = rows.select(
        F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("mtime"),
        F.element_at(F.split("_metadata.file_path", "/"), -2).alias("country"), F.col("value").alias("text"),
    )
    out = rows.join(done.select("name"), "name", "left_anti").orderBy("mtime", "name")
    return out if limit is None else out.limit(limit)


def qa_file(spark: SparkSession, path: str, geo: str) -> DataFrame:
    """SRC-15: a JSON array of question and answer rows, those of one geo."""
    return spark.read.option("multiLine", True).json(path).where(F.col("geo") == geo)


def trace_file(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """MSC-18: tab-separated traces; shorter rows end in nulls."""
    return spark.read.option("sep", "\t").option("mode", "PERMISSIVE").schema(", ".join(f"{c} string" for c in columns)).csv(path)


def write_texts(files: DataFrame, path: str) -> None:
    """SNK-22: bodies as text files, one folder per country."""
    files.select("country", F.col("body").alias("value")).write.mode("overwrite").partitionBy("country").text(path)


def write_shards(urls: DataFrame, path: str) -> None:
    """SNK-28: URLs as sorted text, one folder per language; a language of any size is spread over files by range."""
    urls.repartitionByRange("lang", "url").sortWithinPartitions("lang", "url").select("lang", F.col("url").alias("value")).write.mode("overwrite").partitionBy("lang").text(path)


def write_points(points: DataFrame, path: str, size: int) -> None:
    """SNK-20, SNK-21: vectors of one size, by collection; a vector of another size fails the write."""
    checked = points.withColumn("v", F.when(F.size("v") == size, F.col("v")).otherwise(F.raise_error(F.lit(f"a vector has not {size} components"))))
    checked.write.mode("append").partitionBy("collection").parquet(path)
