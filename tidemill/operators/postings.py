"""A full-text index in files: one row per term and text, clustered by term."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import fixed

from .messages import keyword_expression, oldest_first

#: Folders for terms that begin with other characters than two of a-z and 0-9.
OTHER_FOLDERS = 64


def words_of(columns: Sequence[Column]) -> Column:
    """Runs of letters and digits of all columns, lower-cased."""
    return F.array_remove(F.split(F.lower(F.concat_ws(" ", *columns)), r"[^\p{L}\p{N}]+"), "")


def folder(term: Column) -> Column:
    """The folder of a term: its first two characters, so that what begins alike lies together; a hash where they are others."""
    start = F.substring(term, 1, 2)
    return F.when(start.rlike("^[a-z0-9]+$"), F.concat(F.lit("t-"), start)).otherwise(F.concat(F.lit("o-"), F.pmod(F.xxhash64(term), F.lit(OTHER_FOLDERS)).cast("string")))


def write_index(texts: DataFrame, words: Column, path: str, *, id_col: str = "id", carry: Sequence[str] = ()) -> None:
    """Postings of texts: folder, term, id, n (times), total (different terms of the text), and the carried columns.

    Occurrences are counted in the text's own row, so postings meet once, by folder. A folder of
    very common terms is spread over several files, and rows lie sorted by term in each: a reader
    finds a term by folder, then by the statistics of row groups. At most 1,400 folders, whatever
    the texts. Null texts have no words.
    """
    split = texts.select(F.col(id_col).alias("id"), *carry, F.sort_array(words).alias("__words"))
    # Where a run of equal words begins. Each step is told before the next: inside a lambda it would be done again for each word.
    begins = F.filter(F.sequence(F.lit(0), F.size("__words") - 1), lambda i: ~F.get("__words", i).eqNullSafe(F.get("__words", i - 1)))
    runs = split.withColumn("__begins", F.when(F.size("__words") > 0, begins))
    run = lambda at, k: F.struct(F.get("__words", at).alias("term"), (F.coalesce(F.get("__begins", k + 1), F.size("__words")) - at).alias("n"))
    told = runs.select("id", *carry, F.size("__begins").alias("total"), F.transform("__begins", run).alias("__runs"))
    # inline_outer: inline alone puts a filter on the runs before itself, which splits each text once more.
    each = told.select("id", *carry, "total", F.inline_outer("__runs")).where("term is not null")
    placed = each.select("term", "id", "n", "total", *carry, folder(F.col("term")).alias("folder"))
    # No ranges, whose bounds need a sample and so all texts split twice: large folders are dealt out by their measured size.
    placed.hint("rebalance", "folder").sortWithinPartitions("folder", "term").write.mode("overwrite").partitionBy("folder").parquet(path)


def postings(spark: SparkSession, path: str, expression: str | None) -> DataFrame | None:
    """Postings of a keyword expression (whole terms, or beginnings with a star); None if it is empty or malformed.

    Only the folders of its terms are read: one for a whole term or a beginning of two characters or more.
    """
    if not expression:
        return None
    terms = [t.lower() for t in expression.split(" OR ")]
    if any(not re.fullmatch(r"\w+\*?", t) for t in terms):
        return None
    term, at, tests = F.col("term"), F.col("folder"), []
    for t in terms:
        word = t.removesuffix("*")
        if word == t:
            # The folder of a constant is a constant.
            tests.append((at == folder(F.lit(word))) & (term == word))
        elif not re.fullmatch("[a-z0-9]+", word[:2]):
            tests.append(at.startswith("o-") & term.startswith(word))
        elif len(word) > 1:
            tests.append((at == f"t-{word[:2]}") & term.startswith(word))
        else:
            # A second character of any kind may follow.
            tests.append((at.startswith(f"t-{word}") | at.startswith("o-")) & term.startswith(word))
    return spark.read.parquet(path).where(reduce(or_, tests))


def relevant(messages: DataFrame, index: str, keywords: Sequence[str], rows: Column, limit: int) -> DataFrame:
    """FLT-05, FLT-06, JON-01 by the index: messages with a keyword that pass `rows` (over carried columns), oldest first; all that pass it if none has any.

    The index carries ts and what `rows` reads, so the limit is met before a text is read; the few ids are then broadcast.
    """
    found = postings(messages.sparkSession, index, keyword_expression(keywords))
    if found is not None:
        ids = oldest_first(found.where(rows).select("id", "ts").distinct(), limit).select("id")
        hits = oldest_first(messages.join(F.broadcast(ids), "id", "left_semi"), limit)
        if not ids.isEmpty():
            return hits
    return oldest_first(messages.where(rows), limit)


def search(entries: DataFrame, index: str, query_lemmas: Sequence[str], rows: Column, limit: int) -> DataFrame:
    """TOP-01, TOP-02 by the index: entries (id, question, tags, confidence) that pass `rows` (over carried columns), by score, best first, ids on ties.

    Hits and the size of an entry come from postings; only entries with a hit are read, for the
    words found in question and tags. The score is that of knowledge.search.
    """
    asked = list(dict.fromkeys(query_lemmas))
    found = postings(entries.sparkSession, index, keyword_expression(asked))
    if found is None:
        return entries.withColumn("score", F.lit(0.0)).limit(0)
    hits = found.where(rows).groupBy("id").agg(F.countDistinct("term").alias("__hits"), F.max("total").alias("__total"))
    where = F.lower(F.concat_ws("\n", F.col("question"), F.to_json("tags")))
    bonus = sum((F.when(where.contains(w), 1).otherwise(0) for w in asked), F.lit(0))
    weight = F.create_map(*[F.lit(x) for kv in fixed.CONFIDENCE_WEIGHT.items() for x in kv])[F.col("confidence")]
    score = (bonus * 2.0 + F.col("__hits") / (F.greatest("__total", F.lit(1)) / 10)) * F.coalesce(weight, F.lit(1.0))
    return entries.join(hits, "id").withColumn("score", F.round(score, 9)).drop("__hits", "__total").orderBy(F.desc("score"), "id").limit(limit)
