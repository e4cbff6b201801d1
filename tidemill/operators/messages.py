"""Filters and keyword search over messages (id, channel, ts, text, ...)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import fixed
from tidemill.functions.text import UNICODE

JUNK_ANYWHERE = (
    # Phrases of texts that narrate a question instead of stating a fact.
    r"User (?:is asking|is looking (?:for|to)|wants to know|needs to know|is seeking|is inquiring|is requesting|asks|inquired|wants information)",
    r"A user (?:is asking|asks|wants|is looking|inquired)",
    r"Inquir(?:y|ies) (?:about|is|are)",
    r"Clarification (?:needed|is needed)",
    r"not (?:explicitly )?provided in the log|is not provided in the log",
    r"not specified in the log",
    r"A request for assistance|request for assistance in",
    r"is available for rent|(?:room|apartment|flat) is available",
    r"consult with .{0,40}Telegram|via their Telegram channel",
    r"should be researched",
)
JUNK_OPENERS = (
    # How such texts begin; case counts.
    r"Information (?:on|about|regarding)",
    r"Provide (?:information|instructions|details|guidance|an overview)",
    r"Details (?:on|about|regarding)",
    r"Inquir(?:y|ies|ing)\b",
    r"Seeking\b|Looking for\b|Request(?:ing)? (?:for|information)",
    r"Question(?:s)? (?:about|regarding|on)",
    r"(?:The |A )?[Uu]ser (?:is|wants|needs|seeks|asks)",
    r"Guidance (?:on|is)|Advice (?:is )?(?:sought|requested)",
)


def between(messages: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """FLT-01, FLT-03: messages of an inclusive range; the filter reaches the scan."""
    return messages.where(F.col(ts).between(F.lit(start), F.lit(end)))


def on_day(messages: DataFrame, day: str, ts: str = "ts") -> DataFrame:
    """FLT-02: messages of a calendar day, as a range, so that it can prune."""
    first = F.to_timestamp_ntz(F.lit(day)) if dict(messages.dtypes)[ts] == "timestamp_ntz" else F.to_timestamp(F.lit(day))
    return messages.where((F.col(ts) >= first) & (F.col(ts) < first + F.expr("INTERVAL 1 DAY")))


def oldest_first(messages: DataFrame, limit: int | None = None) -> DataFrame:
    out = messages.orderBy("ts", "id")
    return out if limit is None else out.limit(limit)


def keyword_expression(keywords: Sequence[str]) -> str | None:
    """FLT-05: keywords as an OR expression: whole tokens, or beginnings with a trailing star. None if there are none."""
    words = [k.strip() for k in keywords if k and k.strip()]
    return " OR ".join(words) if words else None


def matches(expression: str | None, columns: Sequence[Column]) -> Column | None:
    """Whether any of the columns has a token of the expression; None if it is empty or malformed.

    Tokens are runs of letters and digits, in any case.
    """
    if not expression:
        return None
    terms = expression.split(" OR ")
    if any(not re.fullmatch(r"\w+\*?", t) for t in terms):
        return None
    tokens = F.split(F.lower(F.concat_ws(" ", *columns)), r"[^\p{L}\p{N}]+")
    whole = [t.lower() for t in terms if not t.endswith("*")]
    starts = [t[:-1].lower() for t in terms if t.endswith("*")]
    test = F.lit(False)
    if whole:
        test = test | F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in whole]))
    if starts:
        test = test | F.exists(tokens, lambda t: reduce(or_, [t.startswith(s) for s in starts]))
    return test


def relevant(messages: DataFrame, keywords: Sequence[str], limit: int | None = None) -> DataFrame:
    """FLT-06, JON-01: messages with a keyword in id, channel, date or text, oldest first; all of them if none has any.

    The fallback is part of one plan: rows count as hits, or as the rest, which
    counts only where there is no hit.
    """
    hit = matches(keyword_expression(keywords), [F.col("id"), F.col("channel"), F.col("ts").cast("string"), F.col("text")])
    if hit is None:
        return oldest_first(messages, limit)
    hits = messages.where(hit)
    none = hits.limit(1).agg(F.count("*").alias("__n")).where("__n = 0").drop("__n").select(F.lit(1).alias("__one"))
    rest = messages.crossJoin(F.broadcast(none)).drop("__one")  # one row or none
    return oldest_first(hits.unionByName(rest), limit)


def is_junk(text: Column) -> Column:
    """FLT-10, FLT-11: whether a text narrates a question, offer or nothing instead of a fact."""
    anywhere = text.rlike(r"(?i)\b(?:" + "|".join(JUNK_ANYWHERE) + r")\b")
    return F.coalesce(anywhere | text.rlike(r"^\s*(?:" + "|".join(JUNK_OPENERS) + ")"), F.lit(False))


def is_question(text: Column, pattern: str = fixed.QUESTION) -> Column:
    return text.rlike(UNICODE + pattern)


def is_useful(text: Column, pattern: str = fixed.USEFUL) -> Column:
    return text.rlike(UNICODE + pattern)


def is_noise(text: Column, pattern: str = fixed.NOISE) -> Column:
    return text.rlike(UNICODE + pattern)


def human(messages: DataFrame, pattern: str = fixed.BOT, blocked: Sequence[str] = ()) -> DataFrame:
    """FLT-08, FLT-16: messages not from bots, by flag (null is no bot), text and sender."""
    out = messages.where(F.coalesce(~F.col("is_bot"), F.lit(True)) & ~F.coalesce(F.col("text").rlike(UNICODE + pattern), F.lit(False)))
    return out.where(~F.coalesce(F.col("sender_id").cast("string").isin(*blocked), F.lit(False))) if blocked else out


def non_empty(messages: DataFrame) -> DataFrame:
    """FLT-09."""
    return messages.where(F.coalesce(F.trim("text") != "", F.lit(False)))


def newest_per_channel(messages: DataFrame, n: int) -> DataFrame:
    """SRC-03: the newest n messages of each channel; the rank limit is applied before the shuffle too."""
    w = Window.partitionBy("channel").orderBy(F.desc("ts"), F.desc("id"))
    return messages.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def corpus_lines(messages: DataFrame, limit: int = 500, width: int = 500) -> DataFrame:
    """TOP-12: the first messages, each cut to a width."""
    from tidemill.functions.text import shortened

    return oldest_first(messages, limit).withColumn("text", shortened(F.col("text"), width))
