"""Quality rules as a ledger: each rule is evaluated once, policies and ablations work on its bits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

SPACE = r"[\x20\x09-\x0D]+"
#: Characters that count as symbols (fixed value).
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A rule over the measurements; `fails` is SQL, in whole numbers."""

    name: str
    fails: str


#: In the order of their bits. New rules go to the end, so that stored ledgers keep their meaning.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("duplicate_lines", "n_lines >= 5 and 100 * n_dup_lines > 40 * n_lines"),
    Rule("word_length", "10 * word_chars < 25 * n_words or 10 * word_chars > 120 * n_words"),
    Rule("capitals", "100 * n_capitals > 40 * word_chars"),
)

#: Versions of the policy: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length", "capitals"),
}


def mask(policy: str | Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    """The bits of a policy's rules."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    places = {r.name: k for k, r in enumerate(rules)}
    return sum(1 << places[n] for n in names)


def let(value: Column, body) -> Column:
    """body(value), with value computed once, as a lambda's argument."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of three words that occurs twice or more.

    Hashes of the windows tell texts without a repeat. Otherwise windows are sorted with their
    places, equal neighbours are found by their words, and the places they cover are counted.
    """
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    window = lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), words[i].alias("a"), words[i + 1].alias("b"), words[i + 2].alias("c"), i.alias("at"))
    same = lambda x, y: (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def covered(s: Column) -> Column:
        last = F.size(s) - 1
        twice = lambda x, k: F.when(k > 0, same(x, s[F.greatest(k - 1, F.lit(0))])).otherwise(False) | F.when(k < last, same(x, s[F.least(k + 1, last)])).otherwise(False)
        places = F.transform(F.filter(s, twice), lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2))
        return F.size(F.array_distinct(F.flatten(places)))

    exact = let(F.sort_array(F.transform(starts, window)), covered)
    return F.when(F.size(words) < 4, 0).when(F.size(F.array_distinct(hashes)) == F.size(words) - 2, 0).otherwise(exact).cast("long")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the measurements of each whole text in place of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    kept = [c for c in docs.columns if c != text_col and not c.startswith("__")]
    rows = docs.select(
        *kept,
        F.array_remove(F.split(text, SPACE), "").alias("__words"),
        count(SYMBOLS).alias("n_symbols"),
        count("[A-Z]").alias("n_capitals"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("__lines"),
    )
    return rows.select(
        *kept,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_capitals",
        F.col("__lines.n").alias("n_lines"),
        F.col("__lines.dup").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(docs: DataFrame, *, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: its columns but the text, the measurements, and `failed`, a bit for each rule it fails.

    Null and empty texts have no words and fail few_words; whole texts are measured, in
    memory that is some thirty times the longest text, as one row. Equal rows and null ids are rows like any
    other; columns of docs called as a measurement, or failed, are replaced; an empty table gives none.
    """
    names = {*MEASURES, "failed"}
    rows = measured(docs.select(*[c for c in docs.columns if c not in names or c == text_col]), text_col)
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(0) for k, r in enumerate(rules)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return rows.withColumn("failed", failed.cast("long"))


def apply_policy(rows: DataFrame, policy: str | Sequence[str], *, rules: Sequence[Rule] = RULES) -> DataFrame:
    """A ledger with `kept`: whether no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy, rules))) == 0)


def ablation(rows: DataFrame, policy: str | Sequence[str], *, rules: Sequence[Rule] = RULES) -> DataFrame:
    """What each rule of a policy does, from a ledger alone.

    Returns rule, bit, n_failed (documents that fail it), n_only (that fail it and no other rule of the
    policy: those that would come back without it), n_kept_without and n_words_only. Documents are
    first counted by their bits, so at most 2^rules rows meet the rules. An empty ledger gives no rows.
    """
    all_bits = mask(policy, rules)
    names = POLICIES[policy] if isinstance(policy, str) else policy
    seen = rows.groupBy(F.col("failed").bitwiseAND(F.lit(all_bits)).alias("bits")).agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    each = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(rules) if r.name in names]
    per_rule = seen.select("bits", "n", "words", F.inline(F.array(*each)))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    only = F.col("bits") == F.col("bit")
    total = lambda what, when: F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0))
    return per_rule.groupBy("rule", "bit").agg(
        total("n", hit).alias("n_failed"), total("n", only).alias("n_only"), total("n", only | (F.col("bits") == 0)).alias("n_kept_without"), total("words", only).alias("n_words_only")
    )
