"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.plans.adapters import table
from tidemill.sources.store import cut_lineage as materialize

__all__ = ["BROADCAST_ROWS", "WORD", "materialize", "sized", "table", "word_count"]

#: Words are maximal runs of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a counted side (ids, keys or offsets, tens of bytes a row) is broadcast.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame) -> DataFrame:
    """df, marked for broadcasting if its counted rows permit; else it is left to a shuffle join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def word_count(text: Column) -> Column:
    """Number of words in text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
