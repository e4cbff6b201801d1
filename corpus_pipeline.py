"""A training corpus in five stages: toxicity, repeated lines, near-duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. run() writes each stage's rows to the shared
folder and reads them again as the next one's docs.

In every stage null and empty texts stay, unless they are copies of each other; ids may be
null, repeated or tied; an empty table stays empty; texts of any length are read whole; and columns
beside those of documents are handed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import lines, mixing, packing, simhash, toxicity
from tidemill.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores below 0.7; null and empty texts stay, equal texts go or stay alike."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document or line has, earlier by id, then line; those that had nothing else go. Null and empty texts had no lines, and stay."""
    # The operator's own counts have names that documents may have, too.
    own = {c: f"__own_{c}" for c in docs.columns if c in ("n_lines", "n_removed")}
    cleaned = lines.dedup_lines(docs.withColumnsRenamed(own), drop_emptied=True).drop("n_lines", "n_removed")
    cleaned = cleaned.withColumnsRenamed({v: k for k, v in own.items()})
    return cleaned.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group whose shingles of five words are similar by 0.8 or more; documents without words are copies of each other only, and null ids stay."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: its repeats are rows. Rows equal in id and text are interchangeable; documents without words weigh nothing."""
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: where each piece of each document goes; null text is the end token alone."""
    return packing.pack_documents(docs, keep_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The learned toxicity score and the fingerprints have no SQL form; tests/llm/test_pipeline.py checks stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
