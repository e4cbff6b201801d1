"""Ids, hashes, JSON, maps, numbers and dates as column expressions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sha1_id(*parts: Column, length: int = 24) -> Column:
    """FN-01: leading hex digits of the SHA-1 of parts joined by colons."""
    return F.substring(F.sha1(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, length)


def md5_id(text: Column, length: int = 12) -> Column:
    """FN-02: leading hex digits of an MD5."""
    return F.substring(F.md5(text.cast("binary")), 1, length)


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_DNS) -> Column:
    """VEC-21: the name-based (SHA-1) UUID of a text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def json_list(values: Column) -> Column:
    """FN-03: an array as JSON."""
    return F.to_json(values)


def from_json_list(text: Column) -> Column:
    """FN-03: a JSON array of strings; anything else is empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def patterns_of(reply: Column, schema: str) -> Column:
    """FN-04: rows of a reply that is a JSON list, or an object with `patterns`, perhaps in a code fence; empty if neither."""
    from .text import strip_fence

    body = strip_fence(reply)
    as_list = F.from_json(F.when(F.trim(body).startswith("["), body), f"array<{schema}>")
    inside = F.from_json(body, f"struct<patterns:array<{schema}>>")["patterns"]
    return F.coalesce(as_list, inside, F.array().cast(f"array<{schema}>"))


def salvage(text: Column, need: str) -> Column:
    """FN-05: JSON objects that have the key `need`, from broken JSON: any balanced piece that parses, the outermost first."""

    def objects(raw: str) -> list[str]:
        # One pass with a stack of open braces; a piece counts unless one that counts encloses it.
        opened: list[int] = []
        spans: list[tuple[int, int]] = []
        for i, ch in enumerate(raw):
            if ch == "{":
                opened.append(i)
            elif ch == "}" and opened:
                spans.append((opened.pop(), i + 1))
        found, until = [], -1
        for lo, hi in sorted(spans):
            if lo < until:
                continue
            try:
                value = json.loads(raw[lo:hi])
            except ValueError:
                continue
            if isinstance(value, dict) and need in value:
                found.append(raw[lo:hi])
                until = hi
        return found

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else objects(t))

    return run(text)


def retry_after(body: Column) -> Column:
    """FN-07: seconds to wait that an error names, or null."""
    return F.regexp_extract(body, r"(?i)retry(?:[-_ ]?(?:after|in|delay))?\W+(\d+(?:\.\d+)?)\s*s?", 1).try_cast("double")


def mapped(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """FN-12: a literal map's value, or a default."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def claim_confidence(chain_size: Column) -> Column:
    """FN-10: high from three messages on, else medium."""
    return F.when(chain_size >= 3, "high").otherwise("medium")


def stored_confidence(count: Column) -> Column:
    """Q8: high from three confirmations on, else low; medium never comes out."""
    return F.when(count >= 3, "high").otherwise("low")


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    """WIN-13."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(as_col(low), F.least(as_col(high), value))


def quota_day(ts: Column, zone: str = "America/Los_Angeles") -> Column:
    """DT-04, DT-05: calendar day in a zone of a UTC time."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def file_day(name: Column) -> Column:
    """DT-07: noon of the day that a file name begins with, or null."""
    return F.try_to_timestamp(F.concat(F.nullif(F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})_", 1), F.lit("")), F.lit(" 12:00:00")))


def hours_between(earlier: Column, later: Column) -> Column:
    """DT-08: whole hours."""
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 3600).cast("long")


def merged_sets(*arrays: Column) -> Column:
    """SET-01: union of arrays, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))))


def topic_hash(hashes: Column) -> Column:
    """AGG-16: aggregate; MD5 of the sorted hashes of a group."""
    return F.md5(F.array_join(F.array_sort(F.collect_list(hashes)), "").cast("binary"))


def fact_hash(*fields: Column) -> Column:
    """AGG-16: SHA-256 of fields as canonical JSON, 16 digits."""
    return F.substring(F.sha2(F.to_json(F.struct(*fields)).cast("binary"), 256), 1, 16)


def fan_out(*routes: tuple[Column, Column]) -> Column:
    """FN-09: array of the structs whose condition holds, to explode: one row becomes none or several."""
    return F.array_compact(F.array(*[F.when(cond, value) for cond, value in routes]))


def schema_org(kind: str, fields: Sequence[Column]) -> Column:
    """FN-14: JSON-LD of a struct."""
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type"), *fields))
